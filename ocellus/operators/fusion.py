"""Rank fusion: the candidates of several retrievers merged, weighted and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.functions.text import has_cjk, matches, round4, snippet, strip
from ocellus.operators.retrieval import names_any

SOURCES = ("raw", "rewrite", "semantic", "author")
# fixed values: the weights of the final score, and of raw and rewritten full text by the query's script
SEMANTIC, AUTHOR, TITLE, KEYWORD, RECENCY, BONUS = 0.55, 0.60, 0.10, 0.05, 0.03, 0.04
TEXT_WEIGHTS = {"mixed": (0.17, 0.15), "cjk": (0.12, 0.20), "latin": (0.24, 0.06)}
MOST = 1000  # candidates of one retriever; each gives 100, two merged ones 200
RECENT_POOL = 30  # fixed value: "most recent" reorders so many of the best
FINAL_SHARE, JUDGE_SHARE = 0.75, 0.25  # fixed values: of the blend with an outside judge's scores


def script_of(query: str) -> str:
    cjk, latin = has_cjk(query), any(c.isascii() and c.isalpha() for c in query or "")
    return "mixed" if cjk and latin else "cjk" if cjk else "latin"


def merge_scores(maps: list[DataFrame]) -> DataFrame:
    """Each id with the greatest of its scores."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out.groupBy("id").agg(F.max("score").alias("score"))


def candidates(found: dict[str, DataFrame]) -> DataFrame:
    """(id, raw, rewrite, semantic, author, hits): a full outer merge as one union and one aggregation. A missing score is null."""
    parts = [df.select("id", F.lit(s).alias("source"), "score") for s, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(*[F.max(F.when(F.col("source") == s, F.col("score"))).alias(s) for s in SOURCES]).withColumn("hits", sum((F.col(s).isNotNull().cast("int") for s in SOURCES), F.lit(0)))


def year_bounds(papers: DataFrame) -> DataFrame:
    """(first_year, last_year) of papers with a year, in one row."""
    return papers.filter("year <> 0").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def recency():
    first, last, year = F.col("first_year"), F.col("last_year"), F.col("year")
    place = F.least(F.greatest((year - first) / (last - first), F.lit(0.0)), F.lit(1.0))
    return F.when(F.coalesce(year, F.lit(0)) == 0, 0.0).when(first.isNull(), 0.0).when(first == last, 1.0).otherwise(place)


def in_years(year_from: int | None, year_to: int | None):
    out = F.lit(True)
    if year_from is not None:
        out &= F.col("year") >= year_from
    if year_to is not None:
        out &= F.col("year") <= year_to
    return out


def fuse(papers: DataFrame, found: dict[str, DataFrame], query: str, include: list[str] = (), exclude: list[str] = (), year_from: int | None = None, year_to: int | None = None, bounds: DataFrame | None = None, most: int | None = MOST) -> DataFrame:
    """One row per candidate that passes the filters, with its scores rounded to four decimals. Of every retriever the best `most` count, so that few are
    broadcast to the papers; with None all do, by an ordinary join. bounds: year_bounds() of all papers where they are known already."""
    if most is None:
        joined = papers.join(candidates(found), "id")
    else:
        joined = papers.join(F.broadcast(candidates({s: df.orderBy(F.col("score").desc(), "id").limit(most) for s, df in found.items()})), "id")
    if include:
        joined = joined.filter(names_any(list(include)))
    if exclude:
        joined = joined.filter(~names_any(list(exclude)))
    joined = joined.filter(in_years(year_from, year_to)).crossJoin(F.broadcast(year_bounds(papers) if bounds is None else bounds))  # one row
    raw_weight, rewrite_weight = TEXT_WEIGHTS[script_of(query)]
    q = query.strip().lower()
    score = {s: F.coalesce(s, F.lit(0.0)) for s in SOURCES}
    title_hit = matches("title", q).cast("double")
    keyword_hit = F.exists("keywords", lambda k: matches(k, q)).cast("double")
    final = SEMANTIC * score["semantic"] + raw_weight * score["raw"] + rewrite_weight * score["rewrite"] + AUTHOR * score["author"] + TITLE * title_hit + KEYWORD * keyword_hit + RECENCY * recency() + BONUS * F.least("hits", F.lit(4)) / 4.0
    names = F.filter(F.array(*[F.when(F.col(s).isNotNull(), F.lit(label)) for s, label in zip(SOURCES, ("raw_fts", "rewrite_fts", "embedding", "author"), strict=True)]), lambda x: x.isNotNull())
    citation = F.nullif(strip("citation"), F.lit(""))
    return joined.select(
        "id",
        "title",
        F.array_join("authors", ", ").alias("authors"),
        "year",
        "keywords",
        F.coalesce(snippet("abstract", 180, "..."), F.lit("")).alias("abstract_snippet"),
        citation.alias("citation"),
        snippet(citation, 140, "…").alias("citation_snippet"),
        round4(final).alias("final_score"),
        round4(F.greatest(score["raw"], score["rewrite"])).alias("fts_score"),
        round4(score["semantic"]).alias("semantic_score"),
        round4(score["author"]).alias("author_score"),
        round4(recency()).alias("recency_score"),
        round4(score["raw"]).alias("raw_fts_score"),
        round4(score["rewrite"]).alias("rewrite_fts_score"),
        "hits",
        names.alias("sources"),
    )


def blend(scored: DataFrame, judged: DataFrame) -> DataFrame:
    """Blends the final score with a judge's (id, judge_score) where there is one, however many there are."""
    joined = scored.join(judged, "id", "left")
    mixed = round4(FINAL_SHARE * F.col("final_score") + JUDGE_SHARE * F.col("judge_score"))
    return joined.withColumn("final_score", F.when(F.col("judge_score").isNotNull(), mixed).otherwise(F.col("final_score"))).withColumn("judge_score", round4("judge_score"))


def ordered(scored: DataFrame, sort: str = "best_match", limit: int | None = None) -> DataFrame:
    """Best match: by score, year and id. Most recent: the 30 best matches by year, score and id."""
    year = F.coalesce("year", F.lit(0))
    by_score = [F.col("final_score").desc(), year.desc(), F.col("id")]
    if sort == "most_recent":
        out = scored.orderBy(*by_score).limit(RECENT_POOL).orderBy(year.desc(), F.col("final_score").desc(), "id")
    elif sort == "best_match":
        out = scored.orderBy(*by_score)
    else:
        raise ValueError("sort must be best_match or most_recent")
    return out if limit is None else out.limit(limit)
