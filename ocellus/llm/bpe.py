"""Byte-level BPE over whole columns of text, without a regular expression.

Pre-tokenisation works on arrays. All texts of a batch become one array of codepoints, each with a class. A class is a
function from the state after the character before it to the state after it; functions compose associatively, so all
prefix states follow from a scan by doubling, which ends as soon as every composed function is constant (after a few
steps, since nearly every character alone fixes the state). State before and class of a character say whether a
piece begins there. The pieces are slices of the UTF-8 bytes; their ids come from a cache filled by pair merging.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ocellus.llm.sampling import pieces

PIECE = 1_000_000  # characters of a text that are taken at once
LETTER, NUMBER, OTHER, BLANK, SPACE, SHORT, LONG = range(7)  # classes; BLANK is U+0020, SPACE other white space, SHORT and LONG an apostrophe before 1 or 2 letters of a contraction
AFTER_ONE, AFTER_TWO, DONE = 5, 6, 7  # states beyond those named as the classes 0 to 4: one or two letters of a contraction are to come, or its last has come
# fixed values: the endings that the vocabulary's pattern splits off, lower case only
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("ll", "ve", "re")
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def transitions() -> np.ndarray:
    """[class, state before] -> state after."""
    t = np.empty((7, 8), np.uint8)
    for c in (LETTER, NUMBER, OTHER, BLANK, SPACE):
        t[c] = c
    t[LETTER, AFTER_TWO], t[LETTER, AFTER_ONE] = AFTER_ONE, DONE
    t[SHORT], t[LONG] = AFTER_ONE, AFTER_TWO
    for before in (OTHER, BLANK):  # there the apostrophe goes on a piece and opens none
        t[SHORT, before] = t[LONG, before] = OTHER
    return t


def openings() -> np.ndarray:
    """[class, state before] -> whether a piece begins; white space after white space is decided by what follows."""
    o = np.ones((7, 8), bool)
    o[LETTER, [LETTER, BLANK, AFTER_ONE, AFTER_TWO]] = False
    o[NUMBER, [NUMBER, BLANK]] = False
    for c in (OTHER, SHORT, LONG):
        o[c, [OTHER, BLANK]] = False
    for c in (BLANK, SPACE):
        o[c, [BLANK, SPACE]] = False
    return o


TRANSITIONS, OPENINGS = transitions(), openings()


@functools.cache
def classes() -> np.ndarray:
    """The class of every codepoint."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE] = SPACE
    table[0x20] = BLANK
    return table


def scan_states(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state before each character. first: where texts begin; a text begins as after white space."""
    functions = TRANSITIONS[kind]
    functions[first] = functions[first, SPACE][:, None]
    step = 1
    while step < len(kind):
        open_ = np.flatnonzero((functions != functions[:, :1]).any(axis=1))
        open_ = open_[open_ >= step]
        if not len(open_):
            break
        functions[open_] = np.take_along_axis(functions[open_], functions[open_ - step], axis=1)
        step *= 2
    before = np.r_[np.uint8(SPACE), functions[:-1, 0]]
    before[first] = SPACE
    return before


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin. points: codepoints of texts one after another; first: the first one of each text that isn't empty."""
    n = len(points)
    kind = classes()[points]
    ends = np.zeros(n + 1, bool)
    ends[first] = ends[n] = True
    apostrophe = np.flatnonzero(points == 0x27)
    if len(apostrophe):
        padded = np.r_[points, 0, 0]
        a, b = padded[apostrophe + 1], padded[apostrophe + 2]
        in_one, in_two = ~ends[np.minimum(apostrophe + 1, n)], ~ends[np.minimum(apostrophe + 2, n)]
        kind[apostrophe[in_one & np.isin(a, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        pair = np.zeros(len(a), bool)
        for x, y in LONG_ENDINGS:
            pair |= (a == ord(x)) & (b == ord(y))
        kind[apostrophe[in_one & in_two & pair]] = LONG
    before = scan_states(kind, first)
    starts = OPENINGS[kind, before]
    white = (kind == BLANK) | (kind == SPACE)
    last_white = white & ~np.r_[white[1:], True] & ~ends[1:]  # the last white space before something else stands alone or leads it
    starts |= last_white
    starts[first] = True
    return starts


class Encoder:
    """ids of texts under a vocabulary of byte strings with ranks, where the rank is the id."""

    def __init__(self, vocabulary: bytes, cached: int = 300_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
        self.cached = cached
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.tokens: dict[int, bytes] | None = None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Joins the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary; n log n in the piece's length."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        n = len(part)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) >= n or len(left) + len(part[j]) != size:
                continue
            part[i], part[j] = left + part[j], None
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                if (r := ranks.get(both := part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            if (p := prior[i]) >= 0 and (r := ranks.get(both := part[p] + part[i])) is not None:
                heapq.heappush(heap, (r, p, len(both)))
        return tuple(ranks[x] for x in part if x is not None)

    def pieces(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts, the byte offsets where pieces begin with the end last, and the number of pieces of each text.
        A lone surrogate becomes U+FFFD."""
        whole = "".join(texts)
        raw = whole.encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, np.uint32)
        if lone := np.any((points >= 0xD800) & (points < 0xE000)):
            points = np.where((points >= 0xD800) & (points < 0xE000), 0xFFFD, points)
        data = points.tobytes().decode("utf-32-le").encode() if lone else whole.encode()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths) - lengths
        if not len(points):
            return b"", np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
        starts = piece_starts(points, begin[lengths > 0])
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(width) - width
        before = np.r_[0, np.cumsum(starts)]
        return data, np.r_[offset[starts], len(data)], before[begin + lengths] - before[begin]

    def encode(self, texts: list[str | None], offsets: bool = False):
        """encode_short() of texts of any length: those of over PIECE characters are cut where a letter is followed by a blank, which never changes the pieces."""
        if all(t is None or len(t) <= PIECE for t in texts):
            return self.encode_short(texts, offsets)
        cut = [pieces(t or "", PIECE, lambda a, b: a.isalpha() and b == " ") for t in texts]
        owner = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        got = [self.encode_short([x], offsets) for parts in cut for x in parts]  # one at a time: a piece is a block of its own
        lengths = np.bincount(owner, [int(g[1][0]) for g in got], minlength=len(texts)).astype(np.int64)
        values = np.concatenate([g[0] for g in got])
        if not offsets:
            return values, lengths
        starts, base, last = [], 0, -1
        for g, part, o in zip(got, (x for parts in cut for x in parts), owner.tolist(), strict=True):
            base = base if o == last else 0
            starts.append(g[2] + base)
            base, last = base + len(part.encode("utf-8", "replace")), o
        return values, lengths, np.concatenate(starts)

    def encode_short(self, texts: list[str | None], offsets: bool = False):
        """(values, lengths): the ids of all texts one after another and the number of each text's ids; with offsets also the
        byte in its text at which each id's token begins. Null and empty texts have no ids."""
        clean = [t or "" for t in texts]
        data, at, counts = self.pieces(clean)
        cache, bounds = self.cache, at.tolist()
        if len(cache) > self.cached:
            cache.clear()
        slices = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        found = list(map(cache.get, slices))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    piece = slices[i]
                    if (ids := cache.get(piece)) is None:
                        ids = self.merge(piece)
                        if len(piece) <= 64:
                            cache[piece] = ids
                    found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        values = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        ends = np.r_[0, np.cumsum(sizes)]
        last = np.cumsum(counts)
        lengths = ends[last] - ends[last - counts]
        if not offsets:
            return values, lengths
        width = self.widths()[values]
        byte = np.cumsum(width) - width
        text = np.repeat(np.arange(len(texts)), lengths)
        first = np.cumsum(lengths) - lengths
        return values, lengths, byte - byte[np.minimum(first, max(len(byte) - 1, 0))][text] if len(byte) else byte

    def by_id(self) -> dict[int, bytes]:
        if self.tokens is None:
            self.tokens = {i: b for b, i in self.ranks.items()}
        return self.tokens

    @functools.cached_property
    def _widths(self) -> np.ndarray:
        out = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for b, i in self.ranks.items():
            out[i] = len(b)
        return out

    def widths(self) -> np.ndarray:
        return self._widths

    def decode(self, ids: list[int]) -> str:
        tokens = self.by_id()
        return b"".join(tokens[i] for i in ids).decode()


def default_vocabulary() -> str:
    """Where the installed public tokenizers keep byte_bpe_50k."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary) -> Encoder:
    """One encoder per Python worker and broadcast vocabulary, so that the cache of pieces outlives a task."""
    key = vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value)
    return _encoders[key]


def blocks(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Slices of texts that hold about `chars` characters; a longer text is a slice of its own."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield a, b
            a, size = b, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def encode_column(df: DataFrame, key: str | list[str], text: str, vocabulary: str | None = None, mode: str = "ids") -> DataFrame:
    """mode "ids": (key, ids); "offsets": (key, ids, starts), starts being the byte of the text at which each token begins; "count":
    (key, n_tokens). Null, empty: no ids, an empty list or 0. One row for each row, whatever the key holds; further columns are
    ignored. The vocabulary's file, about 1 MB whatever the data, is read on the driver and broadcast."""
    spark = df.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    keys = [key] if isinstance(key, str) else key
    names = {"ids": ["ids"], "offsets": ["ids", "starts"], "count": ["n_tokens"]}[mode]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema] + [f"{n} {'bigint' if mode == 'count' else 'array<int>'}" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for a, b in blocks(texts, 1_000_000):
                got = encoder.encode(texts[a:b], offsets=mode == "offsets")
                if mode == "count":
                    columns = [pa.array(got[1])]
                else:
                    bounds = pa.array(np.r_[0, np.cumsum(got[1])].astype(np.int32))
                    columns = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (got[0], *got[2:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keys))), *columns], names=[*keys, *names])

    return df.select(*keys, text).mapInArrow(run, schema)
