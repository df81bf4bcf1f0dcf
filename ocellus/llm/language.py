"""Languages of texts and of their segments by multinomial naive Bayes over hashed character n-grams.

Texts are cut into sentences (queries where the script changes as well). All segments of a batch are scored at once: the hashed
n-grams pick rows of a log-probability matrix, which is broadcast, and the rows are summed per segment.

The training labels are those of the table, of which some are wrong and some texts are mixed: a first model is trained on the labels as they are,
a second one on the segments with the language that the first is sure of, and on garbled versions of them, so a wrongly decoded text
gets the language of its original.
"""

from __future__ import annotations

import functools
import io
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.encodings import CHAINS, garble
from ocellus.llm.sampling import hash_samples, pieces

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt")
# fixed values: usual notations of the languages, without region and in lower case
NOTATIONS = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglês"),
    "zh": ("zh", "chi", "zho", "cmn", "chinese", "mandarin", "中文", "汉语"),
    "de": ("de", "ger", "deu", "german", "deutsch", "allemand"),
    "fr": ("fr", "fre", "fra", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
ORDERS, BITS = (0, 1, 2, 3), 16  # order 0: only whether a character is Han, so that Han characters never seen before still tell
SURE = 6.0  # nats between the best language and the next from which a segment counts
SURE_SECOND = 9.0  # and from which it brings in a language besides the text's main one
WORDS, HAN, ODD = 4, 6, 12  # a segment is a sentence from so many words, Han characters or other characters beyond ASCII on
QUERY_WORDS, QUERY_HAN = 3, 4
TEMPER = 6.0
PIECE = 400_000  # characters of a text that are taken at once


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each codepoint: what it is for n-grams (lower case; ASCII other than letters and all white space are a space), and whether it is a letter (1) or Han (2)."""
    n = sys.maxunicode + 1
    to, kind = np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
    for c in range(n):
        if 0xD800 <= c < 0xE000:
            to[c] = 32
            continue
        x = chr(c)
        category = unicodedata.category(x)
        if 0x3400 <= c <= 0x9FFF or 0x20000 <= c <= 0x3FFFF:
            kind[c] = 2
        elif category[0] in "LM":
            kind[c] = 1
            low = x.lower()
            to[c] = ord(low) if len(low) == 1 else c
        elif c < 128 or x.isspace() or category == "Nd":
            to[c] = 32
    return to, kind


@dataclass
class Segments:
    points: np.ndarray  # for n-grams
    begin: np.ndarray  # of each segment
    text: np.ndarray  # number of its text
    offset: np.ndarray  # its first character in the text
    words: np.ndarray
    han: np.ndarray
    odd: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.r_[self.begin, len(self.points)])


def cut(texts: list[str | None], query: np.ndarray) -> Segments:
    """Sentences of all texts; query: for each text whether it is also cut where Han and other letters meet."""
    clean = [t or "" for t in texts]
    raw = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    first = np.cumsum(lengths) - lengths
    n = len(raw)
    to, kind = tables()
    points, k = to[raw], kind[raw]
    owner = np.repeat(np.arange(len(clean)), lengths)
    if not n:
        z = np.zeros(0, np.int64)
        return Segments(points, z, z, z, z, z, z)
    after = np.r_[raw[1:], 10]
    before = np.r_[10, raw[:-1]]
    blank = lambda x: (x == 32) | ((x >= 9) & (x <= 13)) | (x == 0x3000)
    end = np.isin(raw, [ord(c) for c in "。！？；\n\r"]) | (np.isin(raw, [ord(c) for c in ".!?;"]) & blank(after)) | (np.isin(raw, [ord(c) for c in "/=|"]) & blank(after) & blank(before))
    starts = np.zeros(n, bool)
    starts[1:] = end[:-1]
    starts[first[lengths > 0]] = True
    if query.any():
        script = np.where(k == 2, 2, np.where(k == 1, 1, 0))
        at = np.flatnonzero(script)
        if len(at) > 1:
            change = at[1:][script[at[1:]] != script[at[:-1]]]
            starts[change[query[owner[change]]]] = True
    begin = np.flatnonzero(starts)
    space = points == 32
    word = ~space & np.r_[True, space[:-1]] | (~space & starts)
    count = lambda x: np.add.reduceat(x.astype(np.int64), begin)
    return Segments(points, begin, owner[begin], begin - first[owner[begin]], count(word & (k == 1)), count(k == 2), count((raw >= 128) & ~space & (k != 2)))


def grams(s: Segments) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hash of the n-gram at each position, and where there is one; none crosses segments or is all space. First the script."""
    n = len(s.points)
    left = np.repeat(np.r_[s.begin[1:], n], s.lengths) - np.arange(n)  # characters to the segment's end
    h = np.zeros(n, np.uint64)
    space = s.points == 32
    blank = np.ones(n, bool)
    yield (tables()[1][s.points] == 2).astype(np.int64), ~space
    for order in ORDERS[1:]:
        shifted = np.zeros(n, np.uint64)
        shifted[: n - order + 1] = s.points[order - 1 :]
        h = (h * np.uint64(0x9E3779B1) + shifted + np.uint64(order)) & np.uint64(0xFFFFFFFFFFFF)
        now = np.ones(n, bool)
        now[: n - order + 1] = space[order - 1 :]
        blank = blank & now
        mixed = ((h ^ (h >> np.uint64(15))) * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
        yield (mixed >> np.uint64(32 - BITS)).astype(np.int64), (left >= order) & ~blank


@dataclass
class Model:
    """logs[order][hash]: the log-probabilities of an n-gram in each language, less their mean."""

    logs: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.save(out, self.logs)
        return out.getvalue()

    @staticmethod
    def of(counts: np.ndarray) -> Model:
        total = counts.sum(axis=1, keepdims=True)
        logs = np.log((counts + 0.3) / (total + 0.3 * counts.shape[1] / 16))
        logs -= logs.mean(axis=2, keepdims=True)
        return Model(logs.astype(np.float32))

    def score(self, s: Segments) -> np.ndarray:
        """The log-likelihood of each segment in each language, up to what all share."""
        out = np.zeros((len(s.begin), len(LANGUAGES)))
        for order, (hashes, there) in enumerate(grams(s)):
            rows = self.logs[order][hashes]
            rows[~there] = 0
            out += np.add.reduceat(rows, s.begin, axis=0)
        return out / np.sqrt(len(ORDERS) - 1)  # n-grams overlap and so repeat what they say


def counted(texts: list[str], languages: np.ndarray, query: np.ndarray, segment_language: bool = False, weight: float = 1.0) -> np.ndarray:
    """n-gram counts by order, hash and language; languages: a number for each text, or each segment."""
    counts = np.zeros((len(ORDERS), 1 << BITS, len(LANGUAGES)))
    s = cut(texts, query)
    if not len(s.begin):
        return counts
    own = languages if segment_language else languages[s.text]
    per = np.repeat(own, s.lengths)
    for order, (hashes, there) in enumerate(grams(s)):
        ok = there & (per >= 0)
        counts[order] += weight * np.bincount(hashes[ok] * len(LANGUAGES) + per[ok], minlength=(1 << BITS) * len(LANGUAGES)).reshape(1 << BITS, len(LANGUAGES))
    return counts


def language_of(label: str | None) -> str | None:
    """The language that a label names: one of LANGUAGES, "other" for what may name another, None for none."""
    if label is None or not (x := label.strip().lower()):
        return None
    base = x.replace("_", "-").split("-")[0].split("(")[0].strip()
    for language, names in NOTATIONS.items():
        if base in names or x in names:
            return language
    return None if not base.isalpha() or base in ("und", "unknown", "none", "null", "other", "mul", "mis", "zxx", "xx", "n", "na", "unk") else "other"


def margins(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = scores.argmax(axis=1)
    top = np.partition(scores, -2, axis=1)
    return best, top[:, -1] - top[:, -2]


def valid(s: Segments, query: np.ndarray) -> np.ndarray:
    q = query[s.text]
    return (s.words >= np.where(q, QUERY_WORDS, WORDS)) | (s.han >= np.where(q, QUERY_HAN, HAN)) | (s.odd >= ODD)


def train(rows: list[tuple[str, str | None, bool]], garbled: int) -> Model:
    """rows: text, label, whether a query. `garbled` segments of each language are garbled by each chain."""
    numbers = {x: i for i, x in enumerate(LANGUAGES)}
    texts = [r[0] for r in rows]
    query = np.array([r[2] for r in rows], bool)
    labels = np.array([numbers.get(language_of(r[1]) or "", -1) for r in rows], np.int64)
    model = Model.of(counted(texts, labels, query))
    for _ in range(2):
        s = cut(texts, query)
        if not len(s.begin):
            return model
        best, margin = margins(model.score(s))
        own = np.where((margin >= SURE_SECOND) & valid(s, query), best, -1)
        counts = counted(texts, own, query, segment_language=True)
        model = Model.of(counts)
    ends = np.r_[s.begin[1:], len(s.points)] - s.begin
    for language in range(len(LANGUAGES)):
        picked = np.flatnonzero(own == language)[:garbled]
        sentences = [texts[s.text[i]][s.offset[i] : s.offset[i] + ends[i]] for i in picked]
        whole = "\n".join(x.strip() for x in sentences if not x.isascii())
        for chain in CHAINS if whole else ():
            made = garble(whole, chain)
            counts += counted([made], np.array([language]), np.zeros(1, bool), weight=0.1)
    return Model.of(counts)


@functools.lru_cache(maxsize=1)
def loaded(data: bytes) -> Model:
    return Model(np.load(io.BytesIO(data)))


def posterior(scores: np.ndarray) -> np.ndarray:
    """Of log-likelihoods divided by TEMPER, since n-grams of a text depend on each other and make naive Bayes too sure."""
    e = np.exp((scores - scores.max(axis=1, keepdims=True)) / TEMPER)
    return e / e.sum(axis=1, keepdims=True)


def sentence_ends(before: str, after: str) -> bool:
    """Whether cut() begins a segment between two characters in any text."""
    return before in "。！？；\n\r" or (before in ".!?;" and after in " \t\n\x0b\x0c\r\u3000")


def segments_of(texts: list[str | None], query: np.ndarray, model: Model) -> tuple[Segments, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segments, their length, language number, confidence, margin). Texts of over PIECE characters are taken in pieces, cut only where a
    sentence ends, so the segments are those of the whole text."""
    whole = [[t or ""] if len(t or "") <= PIECE else pieces(t, PIECE, sentence_ends) for t in texts]
    if len(texts) == 1 and len(whole[0]) > 1:
        parts, base = [], 0
        for x in whole[0]:
            s, *rest = segments_of([x], query, model)
            s.offset = s.offset + base
            base += len(x)
            parts.append((s, *rest))
        join = lambda k: np.concatenate([getattr(p[0], k) for p in parts])
        merged = Segments(np.zeros(0, np.uint32), join("begin"), join("text"), join("offset"), join("words"), join("han"), join("odd"))
        return merged, *(np.concatenate([p[i] for p in parts]) for i in range(1, 5))
    s = cut(texts, query)
    if not len(s.begin):
        return s, s.begin, s.begin, np.zeros(0), np.zeros(0)
    scores = model.score(s)
    best, margin = margins(scores)
    return s, s.lengths, best, posterior(scores)[np.arange(len(best)), best], margin


def languages_of(texts: list[str | None], query: np.ndarray, model: Model) -> list[list[tuple[str, float]]]:
    """The languages of each text with their confidence, the main one first; none for a text without letters."""
    s, lengths, best, sure, margin = segments_of(texts, query, model)
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    if not len(s.begin):
        return out
    size = s.words * 5 + s.han * 2 + s.odd
    good = valid(s, query) & (margin >= SURE)
    n = len(LANGUAGES)
    mass = np.bincount(s.text[good] * n + best[good], size[good], minlength=len(texts) * n).reshape(-1, n)
    clear = np.bincount(s.text[good] * n + best[good], margin[good] >= SURE_SECOND, minlength=len(texts) * n).reshape(-1, n) > 0
    top = np.zeros(len(texts) * n)
    np.maximum.at(top, s.text[good] * n + best[good], sure[good])
    top = top.reshape(-1, n)
    main = mass.argmax(axis=1)
    for i in np.flatnonzero(mass.any(axis=1)).tolist():
        m = main[i]
        out[i] = [(LANGUAGES[m], float(top[i, m]))] + [(LANGUAGES[j], float(top[i, j])) for j in range(n) if j != m and clear[i, j]]
    rest = [i for i in np.unique(s.text[(s.words > 0) | (s.han > 0)]).tolist() if not out[i]]
    if rest:  # nothing that counts by itself: the text as a whole
        parts = [(j, x) for j, i in enumerate(rest) for x in pieces(texts[i], PIECE, sentence_ends)]
        total = np.zeros((len(rest), n))
        for at in range(0, len(parts), 500):
            some = parts[at : at + 500]
            flat = cut([x for _, x in some], np.zeros(len(some), bool))
            np.add.at(total, np.array([j for j, _ in some])[flat.text], model.score(flat))
        for i, scores in zip(rest, total, strict=True):
            out[i] = [(LANGUAGES[int(scores.argmax())], float(posterior(scores[None])[0].max()))]
    return out


FIELDS = ("title", "abstract", "query", "document")


def training_rows(df: DataFrame, sample: int, longest: int) -> list[tuple[str, str | None, bool]]:
    """At most `sample` texts of each of FIELDS, those of least key hash; of longer ones the first `longest` characters. For training only."""
    lean = df.filter("length(text) > 0").select("field", "record_id", F.substring("text", 1, longest).alias("text"), "label")
    return [(r.text, r.label, r.field == "query") for r in hash_samples(lean, "field", FIELDS, "record_id", sample, 3)]


def broadcast_model(df: DataFrame, sample: int, garbled: int, longest: int):
    model = train(training_rows(df, sample, longest), garbled)
    return df.sparkSession.sparkContext.broadcast(model.dump())  # orders * 65,536 * languages floats whatever the data


def blocks(batch: pa.RecordBatch, chars: int = PIECE) -> Iterator[tuple[int, int, list[str | None], np.ndarray]]:
    texts = batch.column("text").to_pylist()
    query = np.array([f == "query" for f in batch.column("field").to_pylist()], bool)
    a = size = 0
    for b in range(len(texts) + 1):
        if b == len(texts) or (size and size + len(texts[b] or "") > chars):
            if b > a:
                yield a, b, texts[a:b], query[a:b]
            a, size = b, 0
        if b < len(texts):
            size += len(texts[b] or "")


def text_languages(df: DataFrame, sample: int = 1500, garbled: int = 60, longest: int = 4000) -> DataFrame:
    """(field, record_id, label, languages array<struct<lang, confidence>>) of each row of (field, record_id, text, label), the main language first.

    Null, blank and letterless texts have no language. A language besides the main one must have a whole sentence (in a query a phrase of three words or
    four Han characters). Repeated rows are labelled each; an empty table gives no rows; further columns are ignored.
    The model is trained on the first `longest` characters of at most `sample` texts of each field; every text is judged whole."""
    shared = broadcast_model(df, sample, garbled, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(shared.value)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64())]))
        for batch in batches:
            for a, b, texts, query in blocks(batch):
                found = [[{"lang": x, "confidence": y} for x, y in row] for row in languages_of(texts, query, model)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("field", "record_id", "label")), pa.array(found, kind)], names=["field", "record_id", "label", "languages"])

    lean = df.select("field", F.col("record_id").cast("bigint").alias("record_id"), "text", "label")
    return lean.mapInArrow(run, "field string, record_id bigint, label string, languages array<struct<lang: string, confidence: double>>")


def text_segments(df: DataFrame, sample: int = 1500, garbled: int = 60, longest: int = 4000) -> DataFrame:
    """(field, record_id, segment_no, first_char, n_chars, lang, confidence) of each segment with letters; characters count from 0.
    Trained as text_languages()."""
    shared = broadcast_model(df, sample, garbled, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(shared.value)
        for batch in batches:
            for a, b, texts, query in blocks(batch):
                s, lengths, best, sure, _ = segments_of(texts, query, model)
                keep = np.flatnonzero((s.words > 0) | (s.han > 0))
                if not len(keep):
                    continue
                text = s.text[keep]
                first = np.r_[True, text[1:] != text[:-1]]
                at = np.arange(len(keep))
                number = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column("field").slice(a, b - a).take(rows), batch.column("record_id").slice(a, b - a).take(rows), pa.array(number.astype(np.int32)), pa.array(s.offset[keep]), pa.array(lengths[keep]), pa.array([LANGUAGES[i] for i in best[keep].tolist()]), pa.array(sure[keep])], names=["field", "record_id", "segment_no", "first_char", "n_chars", "lang", "confidence"])

    lean = df.select("field", F.col("record_id").cast("bigint").alias("record_id"), "text", "label")
    return lean.mapInArrow(run, "field string, record_id bigint, segment_no int, first_char bigint, n_chars bigint, lang string, confidence double")


def affected(labelled: DataFrame) -> DataFrame:
    """(field, record_id, lang): the languages of texts whose label is missing, names none or one they aren't written in, or that have several."""
    label = F.regexp_replace(F.lower(F.regexp_replace("label", r"(?U)^\s+|\s+$", "")), "_", "-")
    base = F.regexp_replace(F.split_part(F.split_part(label, F.lit("-"), F.lit(1)), F.lit("("), F.lit(1)), r"(?U)\s+$", "")
    named = F.lit(None).cast("string")
    for language, names in NOTATIONS.items():
        named = F.when(base.isin(*names) | label.isin(*names), language).otherwise(named)
    right = F.coalesce(F.exists("languages", lambda x: x["lang"] == F.col("named")), F.lit(False))
    wrong = labelled.withColumn("named", named).filter((F.size("languages") > 1) | ~right)
    return wrong.select("field", "record_id", F.explode("languages").alias("x")).select("field", "record_id", F.col("x.lang").alias("lang"))
