"""The engine: searches over papers and their records."""

from __future__ import annotations

import math
import os
import time
from collections import OrderedDict
from dataclasses import dataclass, field
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.operators import fulltext, fusion, retrieval
from ocellus.plans import providers, understanding
from ocellus.sources import export
from ocellus.sources.locate import locate, read_table
from ocellus.sources.papers import fresh_embeddings, freshness, paper_detail, papers

DEPTH = 100  # fixed value: how many candidates each retriever gives
JUDGED = 10  # fixed value: how many results a judge sees


class Cache:
    """Ranked results by what they were asked with, for a time; the oldest leave first."""

    def __init__(self, seconds: float = 300, entries: int = 64):
        self.seconds, self.entries, self.held = seconds, entries, OrderedDict()

    def get(self, key):
        found = self.held.get(key)
        if found is None or time.monotonic() - found[0] > self.seconds:
            self.held.pop(key, None)
            return None
        return found[1]

    def put(self, key, value) -> None:
        self.held[key] = (time.monotonic(), value)
        self.held.move_to_end(key)
        while len(self.held) > self.entries:
            self.held.popitem(last=False)


@dataclass
class Settings:
    provider: str = "api"
    model: str = "eye-embed-2"
    dimensions: int = 128
    cache_seconds: float = 300

    @staticmethod
    def from_environment() -> Settings:
        e = os.environ
        return Settings(e.get("EMBEDDING_PROVIDER", "api"), e.get("EMBEDDING_MODEL", "eye-embed-2"), int(e.get("EMBEDDING_DIMENSIONS", "128")), float(e.get("SEARCH_CACHE_TTL", "300")))


def source(spark: SparkSession, name: str, at: str | None = None) -> DataFrame:
    """A table from the place given or the one that the environment names."""
    return read_table(spark, name, locate(at))


@dataclass
class Steps:
    """Milliseconds by step."""

    rows: list[tuple[str, float]] = field(default_factory=list)

    def time(self, name: str, function):
        began = time.perf_counter()
        try:
            return function()
        finally:
            self.rows.append((name, (time.perf_counter() - began) * 1000))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, ms double")


class Engine:
    def __init__(self, table_of_papers: DataFrame, keywords: DataFrame | None = None, embeddings: DataFrame | None = None, settings: Settings | None = None, embedder=None, rewriter=None, judge=None, keep: bool = True):
        """keep: hold typed papers and tokens in memory, and on disk what doesn't fit, as every search reads them several times; close(), or the end of a with
        block, lets them go. For a corpus too large for that, prepare() writes it once, and prepared() reads of it what a query needs."""
        self.settings = settings or Settings()
        self.papers = papers(table_of_papers, keywords)
        self.index = fulltext.token_index(self.papers)
        if keep:
            self.papers = self.papers.persist(StorageLevel.MEMORY_AND_DISK)
            self.index = fulltext.token_index(self.papers).persist(StorageLevel.MEMORY_AND_DISK)
        self.embeddings, self.embedder, self.rewriter, self.judge = embeddings, embedder, rewriter, judge
        self.posted, self.corpus, self.known = None, None, {}
        self.cache, self.steps = Cache(self.settings.cache_seconds), Steps()

    @staticmethod
    def over(spark: SparkSession, folder: str, **options) -> Engine:
        return Engine(source(spark, "papers", folder), source(spark, "paper_keywords", folder), source(spark, "paper_embeddings", folder), **options)

    @staticmethod
    def prepare(table_of_papers: DataFrame, keywords: DataFrame | None, folder: str) -> None:
        """Writes typed papers in order of ids, the postings in order of tokens, so that files and row groups of few ids or tokens are found by their statistics, and one
        row of what is known of the whole corpus."""
        spark = table_of_papers.sparkSession
        papers(table_of_papers, keywords).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/typed.parquet")
        typed = spark.read.parquet(f"{folder}/typed.parquet")
        index = fulltext.token_index(typed)
        fulltext.postings(index).repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{folder}/postings.parquet")
        fulltext.corpus_stats(index).crossJoin(fusion.year_bounds(typed)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/corpus.parquet")  # one row each

    @classmethod
    def prepared(cls, spark: SparkSession, folder: str, embeddings: DataFrame | None = None, settings: Settings | None = None, embedder=None, rewriter=None, judge=None) -> Engine:
        """An engine over what prepare() wrote: full text reads the postings of the query's tokens, and the papers of the candidates are found by their ids."""
        own = cls.__new__(cls)
        own.settings = settings or Settings()
        own.papers, own.posted, own.corpus = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("typed", "postings", "corpus"))
        own.embeddings, own.embedder, own.rewriter, own.judge = embeddings, embedder, rewriter, judge
        own.index, own.known = None, {}
        own.cache, own.steps = Cache(own.settings.cache_seconds), Steps()
        return own

    def close(self) -> None:
        for held in (self.index, self.papers):
            if held is not None:
                held.unpersist()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def knows(self, name: str) -> bool:
        """Each name is looked up once."""
        if name not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            self.known[name] = retrieval.knows_author(self.papers, name)
        return self.known[name]

    def matches(self, query: str) -> DataFrame:
        return fulltext.bm25_raw(self.index, query) if self.posted is None else fulltext.bm25_posted(self.posted, self.corpus, query)

    def full_text(self, query: str) -> DataFrame:
        return fulltext.best_of(self.matches(query), DEPTH)

    def local(self, scores: DataFrame) -> DataFrame:
        """The scores of a few hundred candidates at most, brought to the driver by a prepared engine, so that later steps know their ids."""
        if self.posted is None:
            return scores
        return scores.sparkSession.createDataFrame([(r.id, r.score) for r in scores.select("id", "score").collect()], "id bigint, score double")

    def raw_recall(self, query: str) -> DataFrame:
        """Full text and keywords, the greater score of both; where they find nothing, terms. Without prepared postings this is one plan: whether they did is a row joined to
        the terms' result. A prepared engine asks first."""
        direct = fusion.merge_scores([self.full_text(query), retrieval.by_keywords(self.papers, query, DEPTH)])
        if self.posted is not None:
            direct = self.local(direct)
            return direct if not direct.isEmpty() else retrieval.by_terms(self.papers, query, DEPTH)
        nothing = direct.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
        return direct.unionByName(retrieval.by_terms(self.papers, query, DEPTH).crossJoin(F.broadcast(nothing)).select("id", "score"))

    def rewrite_recall(self, queries: list[str]) -> DataFrame:
        return fusion.merge_scores([self.full_text(q) for q in queries])

    def semantic_recall(self, query: str, vector: list[float] | None = None) -> DataFrame | None:
        s = self.settings
        if vector is None and self.embedder:
            got = self.steps.time("embed_query", lambda: providers.attempt(self.embedder, [query]))
            vector = got[0] if got else None
        if vector is None or self.embeddings is None or len(vector) != s.dimensions:
            return None
        length = math.sqrt(sum(x * x for x in vector))
        if not length:
            return None
        return retrieval.nearest_blobs(fresh_embeddings(self.embeddings, self.papers, s.provider, s.model, s.dimensions), [x / length for x in vector], DEPTH)

    def few_hits(self, query: str) -> bool:
        return self.matches(query).limit(understanding.FEW_HITS).count() < understanding.FEW_HITS

    def ranked(self, text: str, year_from: int | None = None, year_to: int | None = None, vector: list[float] | None = None, today: date | None = None) -> tuple[understanding.Query, DataFrame]:
        """The understood query and its scored candidates, not yet ordered."""
        q = self.steps.time("parse", lambda: understanding.parse(text, self.knows, year_from, year_to, today))
        found = {"raw": self.raw_recall(q.text)}
        if (semantic := self.semantic_recall(q.text, vector)) is not None:
            found["semantic"] = semantic
        if self.steps.time("intent", lambda: understanding.wants_author(q, self.knows)):
            found["author"] = retrieval.by_authors(self.papers, understanding.author_query(q), DEPTH)
        rewrite = self.steps.time("rewrite", lambda: providers.attempt(self.rewriter, q.text))
        if understanding.always_expands(q.text) or self.few_hits(q.text):
            chosen = understanding.rewrites(q.text, rewrite)[: understanding.rewrite_limit(q.text)]
            if chosen:
                found["rewrite"] = self.rewrite_recall(chosen)
        if self.posted is None:
            return q, fusion.fuse(self.papers, found, q.text, q.include, q.exclude, q.year_from, q.year_to)
        found = {s: self.local(df) for s, df in found.items()}
        ids = sorted({r.id for df in found.values() for r in df.collect()})  # a few hundred, as local() gives
        return q, fusion.fuse(self.papers.filter(F.col("id").isin(ids)), found, q.text, q.include, q.exclude, q.year_from, q.year_to, self.corpus.select("first_year", "last_year"))

    def search(self, text: str, limit: int = 20, year_from: int | None = None, year_to: int | None = None, sort: str = "best_match", vector: list[float] | None = None, today: date | None = None) -> DataFrame:
        """Ranked results. The cache's key holds everything that shapes the result, sort and limit included."""
        if not text:
            raise ValueError("the query must not be empty")
        key = (text, limit, year_from, year_to, sort, tuple(vector or ()), today)
        if (held := self.cache.get(key)) is not None:
            return held
        q, scored = self.ranked(text, year_from, year_to, vector, today)
        if self.judge:
            top = fusion.ordered(scored, limit=JUDGED).toPandas().to_dict("records")
            if judged := providers.attempt(self.judge, q.text, top):
                scored = fusion.blend(scored, scored.sparkSession.createDataFrame([(int(i), float(s)) for i, s in judged.items()], "id bigint, judge_score double"))
        out = fusion.ordered(scored, sort, limit)
        self.cache.put(key, out)
        return out

    def detail(self, paper_id: int) -> DataFrame:
        return paper_detail(self.papers, paper_id)

    def ris(self, paper_id: int) -> DataFrame:
        return export.ris(self.papers.filter(F.col("id") == paper_id))

    def enw(self, paper_id: int) -> DataFrame:
        return export.enw(self.papers.filter(F.col("id") == paper_id))

    def status(self) -> DataFrame:
        s = self.settings
        if self.embeddings is None:
            return self.papers.agg(F.count(F.lit(1)).alias("papers")).select("papers", F.lit(0).cast("bigint").alias("fresh"), F.col("papers").alias("stale"))
        return freshness(self.embeddings, self.papers, s.provider, s.model, s.dimensions)


class Analytics:
    """The dashboard and its exports over events and unique clicks."""

    def __init__(self, events: DataFrame, clicks: DataFrame):
        self.events, self.clicks = events, clicks

    def dashboard(self, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None, page: int = 1, page_size: int = 20, keyword_limit: int = 20) -> dict[str, DataFrame]:
        from ocellus.operators import usage

        e, c = self.events, self.clicks
        return {
            "overview": usage.overview(e, c, date_from, date_to),
            "top_keywords": usage.top_keywords(e, date_from, date_to, min(max(keyword_limit, 1), 100)),
            "search_count": usage.search_count(e, date_from, date_to, keyword),
            "recent_searches": usage.recent_searches(e, date_from, date_to, keyword, page, page_size),
            "recent_clicks": usage.recent_clicks(c, e, date_from, date_to, keyword),
            "top_paper_clicks": usage.click_ranking(c, date_from, date_to, keyword),
        }

    def export(self, dataset: str, form: str = "csv", date_from: date | None = None, date_to: date | None = None, keyword: str | None = None) -> bytes:
        from ocellus.operators import usage

        rows = usage.export(dataset, self.events, self.clicks, date_from, date_to, keyword)
        filters = {"date_from": date_from and date_from.isoformat(), "date_to": date_to and date_to.isoformat(), "keyword": keyword or None}
        return export.csv_bytes(rows, usage.EXPORTS[dataset]) if form == "csv" else export.json_bytes(rows, dataset, filters)
