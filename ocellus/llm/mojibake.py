"""Texts that were decoded with a wrong encoding.

A multinomial classifier over hashed byte bigrams tells clean words from words garbled by one of the chains of
encodings.py, and from words that lost characters for good. It is trained on clean texts of the table itself, garbled synthetically by
every chain. A word is what lies between ASCII white space; one without a character beyond ASCII can't be garbled. A word's score under a chain is
the best sum of log-likelihood ratios that a stretch of its bigrams reaches. The predicted chain is inverted and must decode strictly; how often
the table has the restored word and the word as it is, counted over all texts, enters as further log-likelihood ratio; then the word is restored.
"""

from __future__ import annotations

import functools
import io
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.bpe import blocks
from ocellus.llm.encodings import CHAINS, SINGLE, garble, name, numbers, restore
from ocellus.llm.sampling import hash_sample

BITS = 16
WORD_BITS = 20  # of the hashed counts of words
LOST_CLASS = len(CHAINS)  # the class after the chains: words with lost characters
PORTION = 2_000_000
PRIOR = 6.0  # nats: log-odds against a given word being garbled, one word in 400
STRONGEST, REPEATED = 7.0, 12  # nats that counts of words may add or take, and the length in bytes from which it is less in proportion: longer words seldom repeat and tell more themselves
CERTAIN = 40.0  # what a word that no chain restores must reach beyond PRIOR: five bigrams at the limit of 8 nats each that a single one may give
PURGE = 60.0  # words of a training text that reach this together, or turn back into UTF-8, keep it from being an example of clean text
UNSEEN = -15.5  # 1.8e-7, between the 1e-8 that a bigram of no class has and one sight among the bigrams of a sample; clean words have none below
RAISED = re.compile("[a-zß-ÿ][À-Þ]|[À-Þ][A-Z][a-z]")  # a capital within a word: no accent was lost there
LATIN, CJK = "A-Za-zÀ-ÖØ-öø-ɏ", "\u3000-\u303f\u3400-\u9fff\uff00-\uffef"
HAS_CJK = re.compile(f"[{CJK}]")
LETTERS = re.compile(f"[{LATIN}]{{4,}}")  # a word of another script within Chinese text; shorter ones are units and signs
LOST = ("�", "ï¿½")  # a lost character, and one that was decoded wrongly once more
GONE = tuple(x.encode() for x in LOST)
BEYOND = re.compile(r"[^\x00-\x7f]+")
ORDINARY = re.compile("[\u00a0-\u017f\u0300-\u036f\u0391-\u03c9\u2000-\u27bf\ufeff\U0001f000-\U0001faff" + CJK + "]*")  # what the texts are written with


def words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The words beyond ASCII of all texts and the number of each word's text."""
    odd = [i for i, t in enumerate(texts) if t and not t.isascii()]
    parts = [texts[i].encode("utf-8", "replace") for i in odd]
    if not parts:
        return [], np.zeros(0, np.int64)
    joined = b" ".join(parts)
    data = np.frombuffer(joined, np.uint8)
    blank = np.r_[np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13))), len(data)]
    gap = np.unique(np.searchsorted(blank, np.flatnonzero(data >= 128)))  # the blank after each word
    begin = np.where(gap > 0, blank[gap - 1] + 1, 0)
    ends = np.cumsum([len(x) + 1 for x in parts])
    return [joined[a:b] for a, b in zip(begin.tolist(), blank[gap].tolist(), strict=True)], np.array(odd, np.int64)[np.searchsorted(ends, begin, side="right")]


def bigrams(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams of all words with a space at either end, and where each word's bigrams begin; a word of n bytes has n + 1. Lost characters
    are bytes of their own, which UTF-8 never has."""
    if any(x in w for w in own for x in GONE):
        own = [w.replace(GONE[0], b"\xff").replace(GONE[1], b"\xfe") for w in own]
    data = np.frombuffer(b" " + b" ".join(own) + b" ", np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, own), np.int64, len(own)) + 1
    return (data[:-1] << 8 | data[1:]) & ((1 << BITS) - 1), np.cumsum(lengths) - lengths


ASCII_ONLY = np.array([(g >> 8) < 128 and (g & 255) < 128 for g in range(1 << BITS)])
OF_LOST = np.array([(g >> 8) >= 0xFE or (g & 255) >= 0xFE for g in range(1 << BITS)])
LIMIT = np.where(OF_LOST, 16, 8).astype(np.float32)  # what one bigram may say: one unseen in the sample may yet be clean, a lost character isn't


def counted(own: list[bytes]) -> np.ndarray:
    """Bigrams of the words; those of two ASCII bytes say nothing of encodings and are not counted."""
    counts = np.bincount(bigrams(own)[0], minlength=1 << BITS).astype(np.float64) if own else np.zeros(1 << BITS)
    counts[ASCII_ONLY] = 0
    return counts


def wide(own: list[bytes]) -> np.ndarray:
    """Which words hold a character of the CJK blocks (lead bytes E3 to E9)."""
    if not own:
        return np.zeros(0, bool)
    grams, begin = bigrams(own)
    lead = grams & 255
    return np.add.reduceat(((lead >= 0xE3) & (lead <= 0xE9)).astype(np.int64), begin) > 0


def parted(own: list[bytes], by: np.ndarray) -> list[np.ndarray]:
    """Counts of the words that aren't `by` and of those that are."""
    return [counted([w for w, x in zip(own, by.tolist(), strict=True) if x == side]) for side in (False, True)]


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word) >> (32 - WORD_BITS)


def running(gain: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """At each bigram the best sum of a stretch that ends there, within its word; gains are within LIMIT."""
    lengths = np.diff(np.r_[begin, len(gain)])
    total = np.cumsum(gain, dtype=np.float64)
    total -= np.repeat(total[begin] - gain[begin] + np.arange(len(begin)) * (40.0 * (lengths.max() + 1)), lengths)  # each word's sums lie below those before it
    return total - np.minimum.accumulate(total - gain)


def promising(most: np.ndarray, grams: np.ndarray, side: np.ndarray, owner: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bigrams, their side, owner and size of each piece): the pieces between two zeros of the best sums of the greatest gains in which these reach the owner's least. What
    reaches it with lesser gains does so within such a piece."""
    begin = np.cumsum(size) - size
    gain = most.ravel().take(grams + (side << BITS))
    enough = np.add.reduceat(np.maximum(gain, 0), begin) >= least[owner]  # no stretch has more than all gains above 0
    if not enough.all():
        inside = np.repeat(enough, size)
        grams, side, gain, owner, size = grams[inside], side[inside], gain[inside], owner[enough], size[enough]
        begin = np.cumsum(size) - size
        if not len(owner):
            return grams, side, owner, size
    best = running(gain, begin)
    fresh = best <= gain
    fresh[begin] = True
    at = np.flatnonzero(fresh)
    of = np.repeat(owner, size)[at]
    keep = np.maximum.reduceat(best, at) >= least[of]
    n = np.diff(np.r_[at, len(grams)])[keep]
    at, of = at[keep], of[keep]
    held = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return grams[held], side[held], of, n


def families() -> list[list[int]]:
    """Classes of like chains: by the encodings of the last step and whether words have CJK characters; most words come near few of them."""
    out: dict[object, list[int]] = {}
    for c, chain in enumerate(CHAINS):
        for k in (2 + 2 * c, 3 + 2 * c):
            out.setdefault((chain[0][0], chain[-1][1] in SINGLE, len(chain), k % 2), []).append(k)
    return [*out.values(), [2 + 2 * LOST_CLASS, 3 + 2 * LOST_CLASS]]


FAMILIES = families()


@dataclass
class Model:
    """logs[k]: the log-probability of each bigram in class k: clean words without and with CJK characters, then of each chain, and of lost characters, in words
    without and with."""

    logs: np.ndarray
    known: frozenset[str] = frozenset()  # characters beyond ASCII of clean words
    counts: np.ndarray = field(default_factory=lambda: np.zeros(1 << WORD_BITS, np.uint32))  # texts with a word, by hash

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, logs=self.logs, known=np.array([ord(c) for c in sorted(self.known)], np.uint32), counts=self.counts)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return Model(x["logs"], frozenset(map(chr, x["known"].tolist())), x["counts"])

    @staticmethod
    def of(classes: list[np.ndarray], known: frozenset[str]) -> Model:
        """Shares mixed with a little of the mean of all classes, so a bigram that no class has says nothing. Only clean words get none of lost characters."""
        shares = [c / max(c.sum(), 1) for c in classes]
        ground = 0.01 * np.mean(shares, axis=0) + 1e-8
        logs = np.array([np.log(0.99 * s + ground) if c.sum() else np.full(1 << BITS, -30.0) for s, c in zip(shares, classes, strict=True)], np.float32)
        logs[:2, OF_LOST] = np.log(1e-8)
        logs[:, ASCII_ONLY] = 0
        return Model(logs, known)

    @functools.cached_property
    def known_points(self) -> np.ndarray:
        """Whether each code point is ASCII or known."""
        out = np.zeros(0x110000, bool)
        out[:128] = True
        out[[ord(c) for c in self.known]] = True
        return out

    @functools.cached_property
    def sound(self) -> np.ndarray:
        """The log-probability of each bigram in clean words without CJK characters, and in those with: these hold words of other scripts as well."""
        return np.array([self.logs[0], self.logs[:2].max(axis=0)])

    @functools.cached_property
    def most(self) -> list[np.ndarray]:
        """For each of FAMILIES the greatest gain that each bigram has in any of its classes, against clean words of either kind; first in any class at all."""
        return [np.clip(self.logs[own].max(axis=0) - self.sound, -LIMIT, LIMIT) for own in ([*range(2, len(self.logs))], *FAMILIES)]

    def judge(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, least, room): for each word and class the best sum of log-likelihood ratios against clean words that a stretch of its bigrams has, 0 where it
        can't come near what it must reach. That is `least`: the prior and the logarithm of the number of stretches among which the best was chosen; `room` is what
        counts may add to it. Words are taken in portions of some PORTION bytes."""
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) // PORTION
        if ends[-1] and len(own) > 1 and ends[0] != ends[-1]:
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(own)]
            parts = [self.judge(own[a:b]) for a, b in itertools.pairwise(cuts)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        grams, begin = bigrams(own)
        lengths = np.diff(np.r_[begin, len(grams)])
        least = PRIOR + np.log(lengths * (lengths + 1) / 2)
        room = STRONGEST * np.minimum(1, REPEATED / lengths)
        scores = np.zeros((len(own), LOST_CLASS + 1))
        cjk = wide(own)
        owner = np.arange(len(own))
        side = np.repeat(cjk, lengths).astype(np.int64)
        grams, side, owner, size = promising(self.most[0], grams, side, owner, lengths, least - room)
        for most, family in zip(self.most[1:], FAMILIES, strict=True):
            if not len(owner):
                break
            g, s, o, n = promising(most, grams, side, owner, size, least - room)
            if not len(o):
                continue
            base, limit, first = self.sound[s, g], LIMIT[g], np.cumsum(n) - n
            words_at = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            held = o[words_at]
            for k in family:
                score = np.maximum.reduceat(running(np.clip(self.logs[k][g] - base, -limit, limit), first), first[words_at])
                c = (k - 2) // 2
                if c == LOST_CLASS:
                    score = np.where(cjk[held] == k % 2, score, 0)  # against clean words of its own kind
                scores[held, c] = np.maximum(scores[held, c], score)
        return scores, least, room

    def clean(self, own: list[bytes]) -> np.ndarray:
        """The log-probability of each word's least likely bigram among clean words."""
        grams, begin = bigrams(own)
        return np.minimum.reduceat(self.sound[1][grams], begin)

    def evidence(self, word: bytes, fixed: bytes, room: float) -> float:
        """What the counts of a word and of what it would be restored to say for the latter; the word itself is one of its count."""
        ratio = np.log((self.counts[word_bucket(fixed)] + 1.0) / max(self.counts[word_bucket(word)], 1.0))
        return float(np.clip(ratio, -room, room))


def suspicious(text: str) -> bool:
    """Sure signs of garbling, to keep such texts out of the first training: lost characters, or neighbouring characters that some single-byte reading turns
    back into UTF-8 of ordinary characters. Elsewhere a decoding says nothing: of the apostrophe and accent in "l’étude" one reading makes an Armenian letter."""
    if any(x in text for x in LOST):
        return True
    for m in BEYOND.finditer(text):
        for wrong in SINGLE:
            back = restore(m.group(), (("utf-8", wrong),))
            if back is not None and back != m.group() and ORDINARY.fullmatch(back):
                if not (HAS_CJK.search(back) and (text[m.start() - 1 : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha())):
                    return True
    return False


def lossy(own: list[bytes]) -> list[bytes]:
    """Words with their first character beyond ASCII lost, as such and decoded wrongly once more."""
    first = [BEYOND.sub(lambda m: LOST[0] + m.group()[1:], w.decode(), count=1) for w in own]
    return [x.encode() for w in [*first, LOST[0]] for x in (w, w.replace(*LOST))]


def train(texts: list[str], garbled: int) -> Model:
    """From texts of the table, some of them garbled: first without those that show sure signs, then without all that the first model finds. The first
    `garbled` clean texts are garbled by each chain."""
    clean = [t for t in texts if not suspicious(t)]
    model = None
    for _ in range(2):
        own, owner = words(clean)
        if model is not None and own:
            np.add.at(model.counts, [word_bucket(w) for w in own], 1)
            found = judged(list(dict.fromkeys(own)), model)
            weights = np.array([found[w].score * (1 + (found[w].back is not None and CHAINS[found[w].chain][0][0] == "utf-8") * PURGE) if w in found and found[w].garbled else 0.0 for w in own])
            bad = set(np.flatnonzero(np.bincount(owner, weights) > PURGE).tolist())
            clean = [t for i, t in enumerate(clean) if i not in bad]
            own, owner = words(clean)
        classes = parted(own, wide(own))
        base = words([t for t in clean if not t.isascii()][:garbled])[0]
        sides = [[w for w, x in zip(base, wide(base).tolist(), strict=True) if x == side] for side in (False, True)]
        for chain in CHAINS:
            for cjk, side in enumerate(sides):
                if chain[0][0] == "gb18030" and not cjk:
                    side = []  # nobody writes other languages in it
                kept = set(side)  # a word that the chain leaves as it is, is no example of it
                made = words([garble(b" ".join(side).decode(), chain)])[0]
                classes.append(counted([w for w in made if w not in kept]))
        for clear, side in zip(classes[:2], sides, strict=True):  # like clean words but for the lost characters
            gone = np.where(OF_LOST, counted(lossy(side)), 0)
            classes.append(clear + gone + OF_LOST * gone.sum() / 2000)
        seen = Counter(b"".join(own).decode())
        model = Model.of(classes, frozenset(c for c, n in seen.items() if n > 1 and not c.isascii()))
    return model


@functools.lru_cache(maxsize=1)
def loaded(data: bytes) -> Model:
    return Model.load(data)


def restored(word: str, chain: int, model: Model) -> str | None:
    """The word with the chain inverted, as a whole or in the runs of characters that the wrong encoding has. Bytes of UTF-8 are told by
    their form; what other encodings give must consist of characters that clean texts hold."""
    steps = CHAINS[chain]
    wrong = steps[-1][1]
    parts = [word]
    if wrong in SINGLE and (whole := restore(word, steps)) is None:
        own = numbers(wrong)
        parts = ["".join(g) for _, g in itertools.groupby(word, key=lambda c: ord(c) in own)]
    changed, out = False, []
    for x in parts:
        back = None if x.isascii() else restore(x, steps)
        if back and back != x and "�" not in back and (steps[0][0] == "utf-8" or (all(c.isascii() or c in model.known for c in back) and not RAISED.search(back))):
            changed = True
            out.append(back)
        else:
            out.append(x)
    if changed and steps[0][0] in ("cp1252", "mac_roman") and HAS_CJK.search(word) and not any(a != b and LETTERS.search(b) for a, b in zip(parts, out, strict=True)):
        return None
    return "".join(out) if changed else None


@dataclass
class Verdict:
    garbled: bool
    chain: int
    back: str | None  # the restored word
    score: float
    alone: tuple[int, str] | None = None  # a chain and what it makes of the word, to be taken where it restores another word of the text


def judged(own: list[bytes], model: Model) -> dict[bytes, Verdict]:
    """The verdict on each of the distinct words that may be garbled. Of the chains that can be inverted strictly, to a word that looks clean itself, that of the highest score with the
    counts' evidence is taken; failing that, only a word that is certain counts, or one that lost characters, which no chain restores. A single Chinese character
    tells little: unless its score is high it is left to the other words of its text."""
    out: dict[bytes, Verdict] = {}
    if not own:
        return out
    scores, least, room = model.judge(own)
    top = scores[:, :LOST_CLASS].max(axis=1)
    tried: list[tuple[int, int, str, bytes, float]] = []
    for i in np.flatnonzero(np.maximum(top, scores[:, LOST_CLASS]) >= least - room).tolist():
        word = own[i].decode()
        for c in np.argsort(-scores[i, :LOST_CLASS]).tolist():
            if scores[i, c] < max(least[i] - room[i], top[i] - 12):
                break
            if (fixed := restored(word, c, model)) is not None:
                data = fixed.encode()
                if (score := scores[i, c] + model.evidence(own[i], data, room[i])) >= least[i]:
                    tried.append((i, c, fixed, data, score))
        if scores[i, LOST_CLASS] >= least[i] or top[i] >= PRIOR + CERTAIN:
            out[own[i]] = Verdict(True, int(scores[i].argmax()), None, float(scores[i].max()))
    good = [x for x in tried if x[3].isascii() or len(x[3].split()) != 1]
    rest = [x for x in tried if not (x[3].isascii() or len(x[3].split()) != 1)]
    lone = []
    if rest:
        after, *_ = model.judge([x[3] for x in rest])
        floor = model.clean([x[3] for x in rest])
        for x, s, f in zip(rest, after.max(axis=1), floor, strict=True):
            written = CHAINS[x[1]][0][0]
            if s >= scores[x[0], x[1]]:
                continue
            if written == "gb18030" and scores[x[0], x[1]] < 30 and (n_han := sum("一" <= c <= "鿿" for c in x[2])) < 2:
                if n_han:
                    lone.append(x)
            elif written not in ("cp1252", "mac_roman") or f > UNSEEN:
                good.append(x)
    for i, c, fixed, _, score in sorted(good, key=lambda x: x[4]):
        out[own[i]] = Verdict(True, c, fixed, score)
    for i, c, fixed, _, score in sorted(lone, key=lambda x: x[4]):
        if own[i] not in out:
            out[own[i]] = Verdict(False, c, None, score)
        if out[own[i]].back is None:
            out[own[i]].alone = (c, fixed)
    return out


REPAIRED = "garbled boolean, chain string, n_passages int, n_restored int, repaired string"


def repair(texts: list[str | None], model: Model) -> list[tuple[bool, str | None, int, int, str | None]]:
    """(garbled, chain, passages, those restored, repaired text) of each text. Every distinct word is judged once."""
    own, owner = words(texts)
    out: list[tuple[bool, str | None, int, int, str | None]] = [(False, None, 0, 0, t) for t in texts]
    found = judged(list(dict.fromkeys(own)), model)
    if not found:
        return out
    bad: dict[int, list[bytes]] = {}
    for w, i in zip(own, owner.tolist(), strict=True):
        if w in found:
            bad.setdefault(i, []).append(w)
    for i, held in bad.items():
        sure = {found[w].chain for w in held if found[w].back is not None}
        fixes = []
        for w in held:
            v = found[w]
            if v.alone and v.alone[0] in sure:
                fixes.append((w, *v.alone))
            elif v.garbled:
                fixes.append((w, v.chain, v.back))
        if not fixes:
            continue
        data, done, parts, end = texts[i].encode("utf-8", "replace"), 0, [], 0
        for w, _, fixed in fixes:
            begin = standing(data, w, end)
            parts += [data[end:begin], w if fixed is None else fixed.encode()]
            end, done = begin + len(w), done + (fixed is not None)
        parts.append(data[end:])
        number = Counter(c for _, c, _ in fixes).most_common(1)[0][0]
        out[i] = (True, "lost" if number == LOST_CLASS else name(CHAINS[number]), len(fixes), done, b"".join(parts).decode())
    return out


def standing(data: bytes, word: bytes, begin: int) -> int:
    """Where a word next stands between white space or ends of the text, not as part of another."""
    at = data.index(word, begin)
    while (at and not data[at - 1 : at].isspace()) or not (data[at + len(word) : at + len(word) + 1] or b" ").isspace():
        at = data.index(word, at + 1)
    return at


def training_sample(df: DataFrame, text: str, key: str, sample: int, longest: int = 20_000) -> list[str]:
    """The `sample` texts of least key hash, of longer ones the first `longest` characters: a bounded sample for training only."""
    rows = hash_sample(df.filter(F.length(text) > 0).select(F.substring(text, 1, longest).alias("t"), F.col(key).alias("k")), "k", sample, 5)
    return [r.t for r in rows]


def census(texts: list[str | None], model: Model, counts: np.ndarray) -> Counter[str]:
    """Adds the texts with each word to counts, by hash of the word. Gives the characters beyond ASCII that the model doesn't know, counted in texts without sure signs of
    garbling in which the model finds none of the words with such a character garbled."""
    seen: Counter[str] = Counter()
    own, owner = words(texts)
    if not own:
        return seen
    numbers_: dict[bytes, int] = {}
    at = np.array([numbers_.setdefault(w, len(numbers_)) for w in own], np.int64)
    buckets = np.fromiter(map(word_bucket, numbers_), np.int64, len(numbers_))
    once = np.unique(owner * len(numbers_) + at) % len(numbers_)
    np.add.at(counts, buckets[once], 1)
    points = np.frombuffer(b"\n".join(numbers_).decode().encode("utf-32-le"), np.uint32)
    new = np.flatnonzero(~model.known_points[points])
    if not len(new):
        return seen
    own_words, which = list(numbers_), np.searchsorted(np.flatnonzero(points == 10), new)
    odd = {own_words[j]: unknown(own_words[j].decode(), model) for j in np.unique(which).tolist()}
    bad = {w for w, v in judged(list(odd), model).items() if v.garbled}
    by_text: dict[int, list[bytes]] = {}
    for w, i in zip(own, owner.tolist(), strict=True):
        if w in odd:
            by_text.setdefault(i, []).append(w)
    for i, held in by_text.items():
        if bad.isdisjoint(held) and not suspicious(texts[i]):
            seen.update(c for w in held for c in w.decode() if c in odd[w])
    return seen


def with_census(df: DataFrame, text: str, model: Model) -> Model:
    """The model with the counts of words over the whole table, and with the characters that clean texts of it hold twice or more. At most 2 ** WORD_BITS counts
    and as many characters as there are code points reach the driver, whatever the data."""
    shared = df.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, seen = loaded(shared.value), np.zeros(1 << WORD_BITS, np.int64), Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts, 500_000):
                seen.update(census(texts[a:b], own, counts))
        at = np.flatnonzero(counts)
        numbers_ = np.r_[at, -1 - np.array([ord(c) for c in seen], np.int64)]  # characters as negative numbers
        yield pa.RecordBatch.from_arrays([pa.array(numbers_.astype(np.int32)), pa.array(np.r_[counts[at], np.array(list(seen.values()), np.int64)])], names=["code", "n"])

    rows = df.select(text).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    code, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(1 << WORD_BITS, np.uint32)
    counts[code[code >= 0]] = np.minimum(n[code >= 0], np.iinfo(np.uint32).max)
    return Model(model.logs, model.known | frozenset(chr(-1 - c) for c in code[code < 0].tolist()), counts)


def unknown(text: str, model: Model) -> set[str]:
    return {c for c in set(text) - model.known if not c.isascii()}


def find_garbled(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 3000, garbled: int = 700, longest: int = 20_000) -> DataFrame:
    """(key, garbled, chain, n_passages, n_restored, repaired) of each row; chain is the one most of its garbled words went through, or "lost" where
    characters are lost for good.

    A text is garbled if one of its words is. Words that can be are restored in `repaired`, all else is left as it is. Null and empty texts are not garbled and stay as they are. Repeated rows are judged each;
    an empty table gives no rows; further columns are ignored. The classifier is trained on the first `longest` characters of at most `sample` texts; every text is judged whole, and
    the characters that a restored word may hold, and the counts of words, are those of the whole table."""
    spark = df.sparkSession
    model = with_census(df, text, train(training_sample(df, text, key, sample, longest), garbled))
    shared = spark.sparkContext.broadcast(model.dump())  # (4 + 2 * len(CHAINS)) * 65,536 floats and 2 ** WORD_BITS counts whatever the data
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, 500_000):
                rows = repair(texts[a:b], own)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(rows)), pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.string())], names=[key, "garbled", "chain", "n_passages", "n_restored", "repaired"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {REPAIRED}")
