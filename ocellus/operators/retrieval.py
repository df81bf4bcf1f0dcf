"""Retrievers besides full text. Each gives (id, score in 0..1), the best `topn` by score and id. The query is known when the plan is made, so
it becomes literals in column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions.text import author_key, author_key_of, has_cjk, is_short_word, matches, strip

# fixed values: words of a query that name no author
LATIN_STOP = ("the", "and", "for", "paper", "article", "recent", "years")
CJK_STOP = ("近两", "最近", "两年", "近三", "三年", "文章", "论文", "作者")
# fixed values: scores of the tiers
EXACT, JOINED, PART, WORDS = 1.0, 0.9, 0.85, 0.35
SURNAME, ONE_FRAGMENT = 0.92, 0.55


def terms_of(query: str) -> list[str]:
    """The terms that stand for a query where it finds nothing as a whole: its words in lower case; of Chinese text the whole and all pairs of
    neighbouring characters."""
    q = query.strip()
    if not q:
        return []
    if has_cjk(q):
        q = "".join(q.split())
        return [q] if len(q) <= 2 else list(dict.fromkeys([q, *(q[i : i + 2] for i in range(len(q) - 1))]))
    return list(dict.fromkeys(q.lower().split()))


def best(scored: DataFrame, topn: int) -> DataFrame:
    return scored.filter("score > 0").orderBy(F.col("score").desc(), "id").limit(topn)


def share(hits: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [h.cast("int") for h in hits]) / float(len(hits))


def holding(term: str):
    """Whether a keyword holds the term or, unless that is a short word, the term holds it."""
    return (lambda k: matches(k, term)) if is_short_word(term) else (lambda k: k.contains(term) | F.lit(term).contains(k))


def keyword_score(query: str) -> Column:
    raw = query.strip().lower()
    words = F.filter(F.transform("keywords", lambda k: F.lower(strip(k))), lambda k: k != "")
    joined = F.array_join(words, " ")
    parts = raw.split()
    if len(parts) > 1:
        rest = WORDS * share([matches(joined, p) for p in parts])
    else:
        tiers = [F.lit(0.0)]
        for t in (x.lower().strip() for x in terms_of(query)):
            part = F.exists(words, holding(t))
            tiers.append(F.when(F.array_contains(words, t), EXACT).when(part, PART).otherwise(0.0))
        rest = reduce(lambda a, b: F.greatest(a, b), tiers)
    return F.when(F.size(words) == 0, 0.0).when(F.array_contains(words, raw), EXACT).when(matches(joined, raw), JOINED).otherwise(rest)


def by_keywords(papers: DataFrame, query: str, topn: int = 100) -> DataFrame:
    """Tiers: a keyword equal to the query; the query in the keywords; the share of its words there; parts of it."""
    if not terms_of(query):
        return papers.select("id", F.lit(0.0).alias("score")).limit(0)
    return best(papers.select("id", keyword_score(query).alias("score")), topn)


def by_terms(papers: DataFrame, query: str, topn: int = 100) -> DataFrame:
    """The share of the query's terms that title, keywords and abstract hold."""
    terms = terms_of(query)
    if not terms:
        return papers.select("id", F.lit(0.0).alias("score")).limit(0)
    text = F.lower(F.concat_ws(" ", "title", F.array_join("keywords", " "), "abstract"))
    return best(papers.select("id", share([matches(text, t) for t in terms]).alias("score")), topn)


def surname_in(query: str) -> str | None:
    """The Chinese surname that a query asks for."""
    q = query or ""
    for pattern in (r"姓\s*([一-鿿])", r"([一-鿿])\s*(?:院长|医生|医师|主任|教授|老师|作者|的文章|的论文)"):  # fixed values: ways to ask
        if m := re.search(pattern, q):
            return m.group(1)
    return q.strip() if len(q.strip()) == 1 and has_cjk(q) else None


def has_surname(surname: str) -> Column:
    """A Chinese name in parentheses, or an author written in Chinese, that begins with the surname."""
    pattern = rf"\(\s*{surname}[一-鿿\s]*\)|^\s*{surname}"
    return F.exists("authors", lambda a: a.rlike(pattern))


def author_score(query: str) -> Column:
    raw = (query or "").strip().lower()
    text = F.lower(F.array_join("authors", " "))
    scores = [F.lit(0.0)]
    if surname := surname_in(query):
        scores.append(F.when(has_surname(surname), SURNAME).otherwise(0.0))
    latin = [t for t in re.findall("[a-z]+", raw) if len(t) >= 2 and t not in LATIN_STOP]
    if latin:
        scores.append(share([matches(text, t) for t in latin]))
    fragments = [t for t in (x.lower() for x in terms_of(query or "")) if has_cjk(t) and len(t) >= 2 and t not in CJK_STOP]
    if fragments:
        found = reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in fragments])
        scores.append(F.when(found >= 2, 1.0).when(found == 1, ONE_FRAGMENT).otherwise(0.0))
    tail = reduce(lambda a, b: F.greatest(a, b), scores) if len(scores) > 1 else scores[0]
    return F.when(text == "", 0.0).when(matches(text, raw), 1.0).otherwise(F.least(tail, F.lit(1.0)))


def by_authors(papers: DataFrame, query: str, topn: int = 100) -> DataFrame:
    return best(papers.select("id", author_score(query).alias("score")), topn)


def names_any(names: list[str]) -> Column:
    """Whether one of the names is among a paper's authors, as written or without white space and punctuation."""
    text = F.array_join("authors", " ")
    out = F.lit(False)
    for n in names:
        if n.strip():
            out |= F.lower(text).contains(n.strip().lower())
        if author_key_of(n):
            out |= author_key(text).contains(author_key_of(n))
    return out


def knows_author(papers: DataFrame, name: str) -> bool:
    """Whether some paper has the author; one to four Latin letters name nobody."""
    key = author_key_of(name)
    if not key or is_short_word(key):
        return False
    return not papers.filter(author_key(F.array_join("authors", " ")).contains(key)).limit(1).isEmpty()


def nearest_arrays(vectors: DataFrame, query: list[float], topn: int = 100, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """Exact cosine search over unit vectors in array columns, in double precision inside the JVM: (id, cosine, score)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector_column), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.filter(F.size(vector_column) == len(query)).select(F.col(id_column).alias("id"), dot.alias("cosine"))
    return scored.withColumn("score", F.least(F.greatest((F.col("cosine") + 1) / 2, F.lit(0.0)), F.lit(1.0))).orderBy(F.col("cosine").desc(), "id").limit(max(topn, 1))


def nearest_blobs(vectors: DataFrame, query: list[float], topn: int = 100) -> DataFrame:
    """The same over (paper_id, blob) with float32 blobs, a matrix product per Arrow batch: (id, score)."""
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column("blob").to_pylist()
            good = [i for i, b in enumerate(blobs) if b is not None and len(b) == 4 * len(q)]
            m = np.frombuffer(b"".join(blobs[i] for i in good), "<f4").reshape(-1, len(q)).astype(np.float64)
            cosine = m @ q
            keep = np.flatnonzero(np.isfinite(cosine))
            yield pa.RecordBatch.from_arrays([batch.column("paper_id").take(pa.array(np.array(good, np.int64)[keep])), pa.array(np.clip((cosine[keep] + 1) / 2, 0, 1))], names=["id", "score"])

    scored = vectors.select("paper_id", "blob").mapInArrow(run, "id bigint, score double")
    return scored.orderBy(F.col("score").desc(), "id").limit(max(topn, 1))
