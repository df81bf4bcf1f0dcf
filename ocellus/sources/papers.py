"""Papers: alias resolution, typed projection, keywords from the child table, vectors and their freshness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions.text import blank_to_null, split_list, strip

# fixed values: the columns that a field may come from, the first present one counts, in any case
ALIASES = {
    "id": ("id",),
    "title": ("title", "标题"),
    "abstract": ("abstract", "摘要", "abstract_text"),
    "year": ("year", "年份", "publication_year"),
    "doi": ("doi",),
    "url": ("url", "网址", "link"),
    "citation": ("citation", "引用", "citation_text"),
    "authors": ("authors", "author", "作者", "authors_display"),
    "keywords": ("keywords", "keyword", "关键词", "keywords_text"),
    "journal": ("journal", "期刊"),
    "volume": ("volume", "卷"),
    "issue": ("issue", "期"),
    "pages": ("pages", "页码"),
    "page_start": ("page_start", "start_page", "起始页"),
    "page_end": ("page_end", "end_page", "结束页"),
}
LISTS, TEXTS = ("authors", "keywords"), ("title", "abstract")


def column_map(names: list[str]) -> dict[str, str | None]:
    """The column of each field; id and title fall back to the first column."""
    by_name = {n.lower(): n for n in reversed(names)}
    found = {field: next((by_name[a] for a in aliases if a in by_name), None) for field, aliases in ALIASES.items()}
    for field in ("id", "title"):
        found[field] = found[field] or names[0]
    return found


def papers(df: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Typed papers from a table under any of the known column names; only columns that are used are read. With a table of keywords, those that a
    paper doesn't have yet are added in their order."""
    at = column_map(df.columns)

    def field(name: str) -> Column:
        source = F.col(f"`{at[name]}`") if at[name] else F.lit(None).cast("string")
        if name == "id":
            return source.cast("bigint")
        if name == "year":
            return strip(source.cast("string")).try_cast("int")
        if name in LISTS:
            return split_list(source.cast("string"))
        if name in TEXTS:
            return F.coalesce(source.cast("string"), F.lit(""))
        return blank_to_null(source.cast("string"))

    out = df.select(*[field(name).alias(name) for name in ALIASES])
    return out if keywords is None else with_keywords(out, keywords)


def ordered_keywords(keywords: DataFrame) -> DataFrame:
    """(paper_id, more): the keywords of each paper in their order, those without order first, blank ones left out."""
    names = {n.lower(): n for n in keywords.columns}
    word = next(names[a] for a in ("keyword", "关键词") if a in names)
    order = next((names[a] for a in ("keyword_order", "order") if a in names), None)
    rank = F.coalesce(F.col(order).cast("int"), F.lit(-1)) if order else F.lit(0)
    rows = keywords.select(F.col("paper_id").cast("bigint").alias("paper_id"), rank.alias("rank"), strip(word).alias("keyword")).filter("keyword <> ''")
    return rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("more")).select("paper_id", F.transform("more", lambda x: x["keyword"]).alias("more"))


def with_keywords(typed: DataFrame, keywords: DataFrame) -> DataFrame:
    more = ordered_keywords(keywords)
    added = F.array_distinct(F.array_except(F.coalesce("more", F.array().cast("array<string>")), F.col("keywords")))
    return typed.join(more, typed["id"] == more["paper_id"], "left").withColumn("keywords", F.concat("keywords", added)).drop("paper_id", "more")


def embedding_text() -> Column:
    """The text that a paper's vector stands for: title, keywords and abstract on lines of their own, blank ones left out."""
    line = strip(F.concat(F.lit("Keywords: "), F.array_join("keywords", ", ")))
    return F.array_join(F.filter(F.array(strip("title"), line, strip("abstract")), lambda x: x != ""), "\n")


def text_hash() -> Column:
    return F.sha2(embedding_text(), 256)


def fresh_embeddings(embeddings: DataFrame, typed: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """(paper_id, blob) of vectors whose text is the paper's present text and whose length is right, one per paper."""
    own = embeddings.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions) & (F.length("embedding_blob") == 4 * dimensions)).select(F.col("paper_id").cast("bigint").alias("paper_id"), "text_hash", F.col("embedding_blob").alias("blob"))
    now = typed.select(F.col("id").alias("paper_id"), text_hash().alias("text_hash"))
    return own.join(now, ["paper_id", "text_hash"]).select("paper_id", "blob")


def freshness(embeddings: DataFrame, typed: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """(papers, fresh, stale) in one row."""
    own = embeddings.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions)).select(F.col("paper_id").cast("bigint").alias("id"), "text_hash").distinct()
    marked = typed.select("id", text_hash().alias("text_hash")).join(own.withColumn("there", F.lit(1)), ["id", "text_hash"], "left")
    return marked.agg(F.count(F.lit(1)).alias("papers"), F.count("there").alias("fresh")).withColumn("stale", F.greatest(F.col("papers") - F.col("fresh"), F.lit(0).cast("bigint")))


def pending_embeddings(embeddings: DataFrame, typed: DataFrame, provider: str, model: str, dimensions: int, force: bool = False) -> DataFrame:
    """(paper_id, text, text_hash) of papers that have no vector of their present text."""
    now = typed.select(F.col("id").alias("paper_id"), embedding_text().alias("text")).withColumn("text_hash", F.sha2("text", 256))
    if force:
        return now
    own = embeddings.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions)).select(F.col("paper_id").cast("bigint").alias("paper_id"), "text_hash")
    return now.join(own, ["paper_id", "text_hash"], "left_anti")


KEY = ("paper_id", "provider", "model", "dimensions")


def newest(rows: DataFrame) -> DataFrame:
    """Of rows with one key the last updated, of those the one with the greatest hash and vector."""
    rest = [c for c in rows.columns if c not in (*KEY, "updated_at")]
    last = rows.groupBy(*KEY).agg(F.max(F.struct("updated_at", *rest)).alias("x"))
    return last.select(*KEY, "x.*").select(*rows.columns)


def upsert_embeddings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The stored rows that no row of `new` replaces, and the newest of `new`; stored rows are only looked up by their key (paper_id, provider, model, dimensions)."""
    own = newest(new)
    return existing.join(own.select(*KEY), list(KEY), "left_anti").select(*existing.columns).unionByName(own)


def embed(pending: DataFrame, embedder, provider: str, model: str, dimensions: int, batch_size: int = 16) -> DataFrame:
    """Rows of paper_embeddings for pending papers. embedder: list of texts -> list of vectors; it runs on the workers, batch by batch."""
    size = max(batch_size, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                vectors = [np.asarray(v, "<f4") for v in embedder(part.column("text").to_pylist())]
                if any(len(v) != dimensions for v in vectors):
                    raise ValueError(f"the embedder must give {dimensions} dimensions")
                yield pa.RecordBatch.from_arrays([part.column("paper_id"), part.column("text_hash"), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["paper_id", "text_hash", "embedding_blob"])

    made = pending.mapInArrow(run, "paper_id bigint, text_hash string, embedding_blob binary")
    return made.select("paper_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), "text_hash", "embedding_blob", F.current_timestamp().cast("timestamp_ntz").alias("updated_at"))


def paper_detail(typed: DataFrame, paper_id: int) -> DataFrame:
    return typed.filter(F.col("id") == paper_id).limit(1).select("id", "title", "authors", "year", "keywords", "abstract", "citation", "doi", "url")
