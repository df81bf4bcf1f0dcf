"""Text functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def collapse(x: Column | str) -> Column:
    """White space as single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(col(x), SPACE, " "))


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(strip(x), F.lit(""))


def split_list(x: Column | str) -> Column:
    """Items of a list separated by ; , or line ends, trimmed, without empty ones, in order, repeated ones kept. Null gives no items."""
    items = F.transform(F.split(F.coalesce(col(x), F.lit("")), r"[;,\n\r]+"), strip)
    return F.filter(items, lambda i: i != "")


def normalize_query(x: Column | str) -> Column:
    """Lower case, white space collapsed; null as the empty string."""
    return collapse(F.lower(F.coalesce(col(x), F.lit(""))))


@functools.cache
def accents() -> tuple[str, str]:
    """Letters with accents and the letters below them: all that decompose to one base letter and marks."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:]):
            pairs.append((c, d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(x: Column | str) -> Column:
    """Lower case without accents; letters that only look like accented ones (ß, ø) stay."""
    plain = F.translate(col(x), accents()[0], accents()[1])
    return F.lower(F.regexp_replace(plain, "[\\u0300-\\u036f]", ""))


def tokens(x: Column | str) -> Column:
    """Runs of letters and digits, folded; a run of Chinese characters is one token."""
    return F.regexp_extract_all(fold(F.coalesce(col(x), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold_text(text: str) -> str:
    return text.translate(dict(zip(map(ord, accents()[0]), accents()[1], strict=True))).translate({c: None for c in range(0x300, 0x370)}).lower()


def tokens_of(text: str) -> list[str]:
    """tokens() of a Python string."""
    out, run = [], ""
    for c in fold_text(text) + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def has_cjk(text: str | None) -> bool:
    return any("一" <= c <= "鿿" for c in text or "")


def is_short_word(text: str) -> bool:
    """One to four ASCII letters: such a word is matched whole, not as a part of others."""
    return 1 <= len(text) <= 4 and text.isascii() and text.isalpha()


def text_matches(text: str | None, needle: str | None) -> bool:
    """matches() of Python strings."""
    hay, n = (text or "").lower(), (needle or "").strip().lower()
    if not hay or not n:
        return False
    if not is_short_word(n):
        return n in hay
    at = hay.find(n)
    while at >= 0:
        before, after = hay[at - 1 : at], hay[at + len(n) : at + len(n) + 1]
        if not (before and before in WORD) and not (after and after in WORD):
            return True
        at = hay.find(n, at + 1)
    return False


WORD = "abcdefghijklmnopqrstuvwxyz0123456789"


def matches(x: Column | str, needle: str) -> Column:
    """Whether a text holds the needle, in any case; a short ASCII word must stand by itself. Null and empty texts and needles don't match."""
    n = needle.strip().lower()
    if not n:
        return F.lit(False)
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return low.rlike(f"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])") if is_short_word(n) else low.contains(n)


def author_key(x: Column | str) -> Column:
    """Lower case without white space and punctuation, for comparing authors."""
    return F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"(?U)[\s,，。.;；:：()（）#'\"-]+", "")


def author_key_of(text: str | None) -> str:
    return "".join(c for c in (text or "").lower() if not c.isspace() and c not in ",，。.;；:：()（）#'\"-")


def snippet(x: Column | str, length: int, mark: str) -> Column:
    """The first characters of a text, with a mark where more follow; blank gives null."""
    t = F.nullif(col(x), F.lit(""))
    return F.when(F.length(t) > length, F.concat(F.substring(t, 1, length), F.lit(mark))).otherwise(t)


def round4(x: Column | str) -> Column:
    """Four decimals, halves up; the same in every engine."""
    return F.floor(col(x) * 10000 + 0.5) / 10000


def clean_author(x: Column | str) -> Column:
    return F.btrim(collapse(F.replace(col(x), F.lit("#"), F.lit(""))), F.lit(" ,;"))


def clean_journal(x: Column | str) -> Column:
    """White space collapsed, dots at the ends dropped; of names joined by dots the last."""
    raw = F.btrim(collapse(F.coalesce(col(x), F.lit(""))), F.lit(" ."))
    parts = F.filter(F.transform(F.split(raw, r"\."), lambda p: F.btrim(p)), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-1))).otherwise(raw)


def beijing_time(x: Column | str) -> Column:
    """A time in UTC, stored without zone, as text in China's time."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), col(x).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def highlight(x: Column | str, query: str) -> Column:
    """Marks the query and its words of two letters or more, longest first, in any case."""
    terms = sorted({t for t in [query.strip(), *query.split()] if len(t) >= 2}, key=lambda t: (-len(t), t))
    if not terms:
        return col(x)
    return F.regexp_replace(col(x), "(?iu)(" + "|".join(map(re.escape, terms)) + ")", "<mark>$1</mark>")


