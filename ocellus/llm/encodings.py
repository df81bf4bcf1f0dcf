"""Wrong decodings: chains of (encoding of the bytes, encoding they were read with), forwards and backwards."""

from __future__ import annotations

import functools

# fixed values: encodings that texts are written in, and those that they are wrongly read with
SINGLE = ("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
DOUBLE = ("gb18030", "cp932", "big5", "cp949")
WRITTEN = {"utf-8": SINGLE + DOUBLE, "cp1252": ("cp1250", "cp1251", "cp437", "cp850", "mac_roman", "utf-8", *DOUBLE), "mac_roman": ("cp1252", "latin-1", "utf-8"), "gb18030": (*SINGLE, "cp932", "big5", "cp949", "utf-8")}

Chain = tuple[tuple[str, str], ...]
CHAINS: tuple[Chain, ...] = (
    *(((w, r),) for w, reads in WRITTEN.items() for r in reads),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("gb18030", "utf-8"), ("utf-8", "cp1252")),
    (("gb18030", "utf-8"), ("utf-8", "gb18030")),
    (("cp1252", "utf-8"), ("utf-8", "cp1252")),
)


def name(chain: Chain) -> str:
    return " ".join(f"{w}>{r}" for w, r in chain)


@functools.cache
def letters(encoding: str) -> tuple[str, ...]:
    """The character of each byte of a single-byte encoding; bytes that it leaves open stand for the control character of that number."""
    return tuple(bytes([b]).decode(encoding, "replace").replace("�", chr(b)) for b in range(256))


@functools.cache
def numbers(encoding: str) -> dict[int, int]:
    return {ord(c): b for b, c in enumerate(letters(encoding))}


def read(data: bytes, encoding: str) -> str:
    if encoding in SINGLE:
        return data.decode("latin-1").translate(letters(encoding))
    return data.decode(encoding, "replace")


def written(text: str, encoding: str) -> bytes:
    """The bytes of a text; characters that the encoding lacks are left out, as garbling needs no exactness."""
    if encoding in SINGLE:
        own = numbers(encoding)
        return bytes(own[ord(c)] for c in text if ord(c) in own)
    return text.encode(encoding, "ignore")


def garble(text: str, chain: Chain) -> str:
    for write, wrong in chain:
        text = read(written(text, write), wrong)
    return text


def restore(text: str, chain: Chain) -> str | None:
    """The text before the chain, or None where a step back isn't strictly possible."""
    try:
        for write, wrong in reversed(chain):
            if wrong in SINGLE:
                own = numbers(wrong)
                data = bytes(own[ord(c)] for c in text)
            else:
                data = text.encode(wrong)
            if write in SINGLE:
                text = data.decode("latin-1").translate(letters(write))
                if write == "cp1252" and any("\x80" <= c <= "\x9f" for c in text):
                    return None
            else:
                text = data.decode(write)
        return text
    except (KeyError, UnicodeError):
        return None
