from datetime import datetime

import numpy as np
import pytest

from ocellus.sources.locate import read_table
from ocellus.sources.papers import papers
from ocellus.sources.stores import EventLog, VectorStore


def test_recording(spark, tmp_path):
    log = EventLog(spark, str(tmp_path))
    assert log.record_page_view("/", visitor_id="v") == 1
    search = log.record_search("Dry  Eye", 3, visitor_id="v", latency_ms=1.5)
    first = log.record_click(7, "P", search_event_id=search, visitor_id="w", occurred_at=datetime(2024, 1, 2))
    log.record_click(7, "P", search_event_id=search)
    log.record_click(8, "Q", search_event_id=search, query="x")
    log.record_click(9, "no search")
    again = EventLog(spark, str(tmp_path))
    assert again.record_click(9, "R", search_event_id=99, query="Own  Query", visitor_id="z") == 7
    got = {(r.search_event_id, r.paper_id): (r.id, r.visitor_id, r.query_normalized) for r in again.clicks.collect()}
    assert got == {(2, 7): (first, "v", "dry eye"), (2, 8): (5, "v", "dry eye"), (99, 9): (7, "z", "own query")}
    assert again.events.count() == 7 and again.events.filter("day = date'2024-01-02'").count() == 1
    with pytest.raises(ValueError):
        log.record_search("x", 1, colour="red")


def test_vectors_are_built_once(spark, tmp_path):
    table = spark.createDataFrame([(i, f"title {i}", "abstract") for i in range(40)], "id int, title string, abstract string")
    typed = papers(table)
    store = VectorStore(spark, str(tmp_path / "vectors"), slots=4)
    asked = lambda texts: [np.full(3, len(t)) for t in texts]
    build = lambda t, **o: store.build(t, asked, "p", "m", 3, batch_size=7, **o)
    assert build(typed, dry_run=True) == {"papers": 40, "pending": 40, "written": 0} and not store.exists()
    assert build(typed)["written"] == 40 and build(typed)["pending"] == 0
    changed = papers(table.selectExpr("id", "case when id = 5 then 'a longer title' else title end title", "abstract"))
    assert build(changed, dry_run=True)["pending"] == 1 and build(changed)["written"] == 1
    rows = {r.paper_id: np.frombuffer(r.embedding_blob, "<f4")[0] for r in store.read().collect()}
    assert len(rows) == 40 and rows[5] == len("a longer title\nKeywords:\nabstract") and rows[6] == len("title 6\nKeywords:\nabstract")
    assert build(changed, force=True)["written"] == 40 and store.read().count() == 40


def test_upserts_touch_only_their_slots(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), slots=8)
    row = lambda i, h, t=None: (i, "p", "m", 2, h, bytes(8), t)
    kind = "paper_id bigint, provider string, model string, dimensions int, text_hash string, embedding_blob binary, updated_at timestamp_ntz"
    store.upsert(spark.createDataFrame([row(i, "a") for i in range(60)], kind))
    before = {p: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "v").glob("slot=*")}
    store.upsert(spark.createDataFrame([row(3, "b", datetime(2024, 1, 1)), row(3, "c", datetime(2024, 1, 2))], kind))
    after = {p: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "v").glob("slot=*")}
    assert sum(before[p] != after[p] for p in before) == 1
    assert {r.paper_id: r.text_hash for r in store.read().collect()} == {i: "c" if i == 3 else "a" for i in range(60)}


def test_a_database_is_read_by_ranges(spark):
    place = "jdbc:derby:memory:ocellus;create=true"
    spark.range(1000).selectExpr("id as paper_id", "cast(id * 2 as string) title").write.format("jdbc").option("url", place).option("dbtable", "papers").save()
    got = read_table(spark, "papers", place, partitions=5)
    assert got.rdd.getNumPartitions() == 5 and got.count() == 1000 and got.agg({"paper_id": "sum"}).first()[0] == 499_500
    assert read_table(spark, "papers", place, ["title"], bounds=(100, 200), partitions=3).count() == 1000
