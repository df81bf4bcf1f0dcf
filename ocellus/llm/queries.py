"""Queries of the llm operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm.bpe import encode_column
from ocellus.llm.distinct import add_buckets, bucket_counts, distinct_visitors, merge_pairs, pairs
from ocellus.llm.frequent import frequent_values
from ocellus.llm.language import affected, text_languages, text_segments
from ocellus.llm.leximin import leximin
from ocellus.llm.mixing import mixture, shares
from ocellus.llm.mojibake import find_garbled
from ocellus.llm.names import resolve, variant_pairs
from ocellus.llm.neighbours import similar_papers, similar_pairs
from ocellus.llm.sql import SQL  # noqa: F401
from ocellus.sources.tables import table

SUPPORT = "0.006"


def p1_entities(spark: SparkSession, folder: str) -> DataFrame:
    return resolve(table(spark, folder, "papers"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(p1_entities(spark, folder))


def p2_frequent(spark: SparkSession, folder: str) -> DataFrame:
    return frequent_values(table(spark, folder, "analytics_events"), "query_normalized", SUPPORT)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_frequent(spark, folder).filter(F.col("query_normalized").rlike(r"(?U)\S")).select("query_normalized")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "paper_embeddings"), least=0.9)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pairs(spark, folder).select("paper_id_a", "paper_id_b")


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar papers of every paper, however far."""
    return similar_papers(table(spark, folder, "paper_embeddings"), k=10)


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(field, record_id, text, label) of every text that came with a label row, and of every document."""
    labels = table(spark, folder, "text_labels").select("field", "record_id", F.col("lang_label").alias("label"))
    papers = table(spark, folder, "papers").select(F.col("paper_id").cast("bigint").alias("record_id"), F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("abstract").alias("field"), F.col("abstract_text").alias("text")))).alias("x"))
    titled = papers.select("x.field", "record_id", "x.text").join(labels, ["field", "record_id"]).select("field", "record_id", "text", "label")
    searches = table(spark, folder, "analytics_events").filter("event_type = 'search'").select(F.col("id").cast("bigint").alias("record_id"), F.col("query_raw").alias("text"))
    asked = searches.join(labels.filter("field = 'query'"), "record_id").groupBy("field", "record_id", "label").agg(F.max("text").alias("text")).select("field", "record_id", "text", "label")
    documents = table(spark, folder, "documents").select(F.lit("document").alias("field"), F.col("doc_id").cast("bigint").alias("record_id"), "text", F.col("lang").alias("label"))
    return titled.unionByName(asked).unionByName(documents)


def p5_languages(spark: SparkSession, folder: str) -> DataFrame:
    return text_languages(labelled_texts(spark, folder))


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    return text_segments(labelled_texts(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return affected(p5_languages(spark, folder))


def p6_distinct_visitors(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_visitors(table(spark, folder, "analytics_events"))


def p6_partials(spark: SparkSession, folder: str) -> DataFrame:
    return bucket_counts(pairs(table(spark, folder, "analytics_events")))


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(table(spark, folder, "analytics_events"))


def p6_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all days and types from partial results made apart: searches, clicks, all else, and once more everything with a visitor, which overlaps them."""
    events = table(spark, folder, "analytics_events")
    kinds = [F.col("event_type") == "search", F.col("event_type") == "paper_click"]
    rest = ~(F.coalesce(kinds[0] | kinds[1], F.lit(False)))
    parts = [pairs(events.filter(k)) for k in (*kinds, rest)]
    return add_buckets(bucket_counts(merge_pairs(*parts, pairs(events))))


def p7_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return leximin(table(spark, folder, "paper_briefs"), support=False).select("search_event_id", "id", "rank")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leximin(table(spark, folder, "paper_briefs"), support=False).filter("rank <= 3").select("search_event_id", "id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_column(table(spark, folder, "documents"), "doc_id", "text")


def p8_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return encode_column(table(spark, folder, "documents"), "doc_id", "text", mode="offsets")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), passes=1)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p9_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p10_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(table(spark, folder, "documents")).filter("garbled").drop("garbled")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(table(spark, folder, "documents")).filter("garbled").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p2_frequent": p2_frequent,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_languages": p5_languages,
    "p5_segments": p5_segments,
    "p6_distinct_visitors": p6_distinct_visitors,
    "p6_partials": p6_partials,
    "p6_pairs": p6_pairs,
    "p6_merged": p6_merged,
    "p7_found": p7_found,
    "p7_ranking": p7_ranking,
    "p8_ids": p8_ids,
    "p8_offsets": p8_offsets,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_repaired": p10_repaired,
}
