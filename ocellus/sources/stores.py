"""Tables that are written to: the event log with its unique clicks, and stored vectors."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.operators import ingest
from ocellus.sources.papers import embed, newest, pending_embeddings
from ocellus.storage import cut_lineage

DAY, SLOT = "day", "slot"
CLICKS = "id bigint, search_event_id int, visitor_id string, query_raw string, query_normalized string, paper_id int, paper_title string, clicked_at timestamp_ntz"


class EventLog:
    """The events, in folders by day, and the unique clicks of a folder. One writer at a time: ids go on from the greatest there is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.last: int | None = None

    def read(self, name: str, schema) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        files = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files)
        return self.spark.read.parquet(path) if there else self.spark.createDataFrame([], schema)

    @property
    def events(self) -> DataFrame:
        found = self.read("analytics_events", ingest.EVENTS)
        return found.select(*ingest.EVENTS.names, *([DAY] if DAY in found.columns else []))

    @property
    def clicks(self) -> DataFrame:
        return self.read("search_paper_unique_clicks", CLICKS)

    def next_id(self) -> int:
        if self.last is None:
            self.last = self.events.agg(F.max("id")).first()[0] or 0
        self.last += 1
        return self.last

    def record_all(self, rows: DataFrame, kind: str | None = None) -> None:
        """Appends a batch of events that have their ids, and the unique clicks among them that aren't there yet."""
        events = cut_lineage(ingest.typed_events(rows, kind))
        ingest.append_events(events, f"{self.folder}/analytics_events.parquet")
        named = events.filter("event_type = 'paper_click' and coalesce(related_search_event_id, 0) <> 0")
        if not named.isEmpty():
            searches = self.events.join(named.select(F.col("related_search_event_id").cast("bigint").alias("id")).distinct(), "id", "left_semi")
            new = ingest.insert_unique(self.clicks, ingest.with_context(named, searches))
            cut_lineage(new).write.mode("append").parquet(f"{self.folder}/search_paper_unique_clicks.parquet")

    def record(self, kind: str, **values) -> int:
        """Appends one event of now, or of its occurred_at, and gives its id. Values without a column of that name are an error."""
        if unknown := set(values) - set(ingest.EVENTS.names):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        number = self.next_id()
        row = {"occurred_at": datetime.now(timezone.utc).replace(tzinfo=None)} | values | {"id": number, "event_type": kind}
        self.record_all(self.spark.createDataFrame([tuple(row.get(n) for n in ingest.EVENTS.names)], ingest.EVENTS))
        return number

    def record_page_view(self, path: str, **values) -> int:
        return self.record("page_view", path=path, **values)

    def record_search(self, query: str, result_count: int, **values) -> int:
        return self.record("search", query_raw=query, result_count=result_count, **values)

    def record_click(self, paper_id: int, paper_title: str | None = None, search_event_id: int | None = None, query: str | None = None, **values) -> int:
        """The first click on a paper of a search becomes a unique click with the visitor and query of the search."""
        return self.record("paper_click", paper_id=paper_id, paper_title=paper_title, related_search_event_id=search_event_id, query_raw=query, **values)


class VectorStore:
    """Vectors in folders by a hash of their paper, so that an upsert writes again only the folders that it touches."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 256):
        self.spark, self.path, self.slots = spark, path, slots

    def slotted(self, rows: DataFrame) -> DataFrame:
        return rows.drop(SLOT).withColumn(SLOT, F.pmod(F.xxhash64(F.col("paper_id").cast("bigint")), F.lit(self.slots)).cast("int"))

    def exists(self) -> bool:
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(SLOT)

    def upsert(self, rows: DataFrame) -> None:
        """New rows replace those with their (paper_id, provider, model, dimensions)."""
        new = cut_lineage(self.slotted(newest(rows)))
        if self.exists():
            touched = [r[0] for r in new.select(SLOT).distinct().collect()]  # at most as many as there are slots
            stored = self.spark.read.parquet(self.path).filter(F.col(SLOT).isin(touched))
            kept = stored.join(new.select("paper_id", "provider", "model", "dimensions"), ["paper_id", "provider", "model", "dimensions"], "left_anti")
            new = cut_lineage(kept.select(*new.columns).unionByName(new))  # read in full before its folders are written
        new.repartition(SLOT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(self.path)

    def build(self, typed: DataFrame, embedder, provider: str, model: str, dimensions: int, batch_size: int = 16, force: bool = False, dry_run: bool = False) -> dict[str, int]:
        """Makes the vectors of papers that have none of their present text, with force of all. Gives the numbers of papers, of those without and of vectors
        written; a dry run writes none."""
        stored = self.read() if self.exists() else self.spark.createDataFrame([], "paper_id bigint, provider string, model string, dimensions int, text_hash string, embedding_blob binary, updated_at timestamp_ntz")
        waiting = pending_embeddings(stored, typed, provider, model, dimensions, force)
        counts = {"papers": typed.count(), "pending": waiting.count(), "written": 0}
        if counts["pending"] and not dry_run:
            made = cut_lineage(embed(waiting, embedder, provider, model, dimensions, batch_size))
            counts["written"] = made.count()
            self.upsert(made)
        return counts
