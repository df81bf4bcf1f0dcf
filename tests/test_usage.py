import json
from datetime import datetime

import pytest

from ocellus.engine import Analytics
from ocellus.operators import ingest, usage
from ocellus.sources import export
from ocellus.sources import papers as source
from ocellus.streaming import events as streams

T = datetime(2024, 3, 1, 23, 0)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        dict(id=1, event_type="search", occurred_at=T, visitor_id="v", query_raw="Dry  Eye", result_count=0),
        dict(id=2, event_type="page_view", occurred_at=T, visitor_id=None, query_raw=None, result_count=None),
        dict(id=3, event_type="paper_click", occurred_at=T, visitor_id=None, query_raw="x", related_search_event_id=1, paper_id=5, paper_title="P"),
        dict(id=4, event_type="paper_click", occurred_at=T, visitor_id="w", query_raw="x", related_search_event_id=1, paper_id=5, paper_title="P"),
        dict(id=5, event_type="paper_click", occurred_at=T, visitor_id="w", query_raw="X y", related_search_event_id=77, paper_id=6, paper_title=""),
        dict(id=6, event_type="paper_click", occurred_at=T, visitor_id="w", query_raw="x", related_search_event_id=None, paper_id=6, paper_title="Q"),
    ]
    names = [f.name for f in ingest.EVENTS]
    raw = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ingest.EVENTS)
    return ingest.typed_events(raw).cache()


def test_unique_clicks_take_the_search_as_context(log):
    got = {(r.search_event_id, r.paper_id): (r.id, r.visitor_id, r.query_normalized) for r in ingest.unique_clicks(log).collect()}
    assert got == {(1, 5): (3, "v", "dry eye"), (77, 6): (5, "w", "x y")}
    assert ingest.insert_unique(ingest.unique_clicks(log), ingest.unique_clicks(log)).collect() == []


def test_dashboard_and_exports(log):
    a = Analytics(log, ingest.unique_clicks(log))
    d = a.dashboard()
    assert d["overview"].first()[:] == (1, 0, 1, 1, 2)
    assert [(r.keyword, r.zero_result_searches) for r in d["top_keywords"].collect()] == [("dry eye", 1)]
    assert [r.searched_at for r in d["recent_clicks"].orderBy("id").collect()] == [T, None]
    text = a.export("searches").decode("utf-8-sig")
    assert text.split("\r\n")[0] == ",".join(usage.EXPORTS["searches"]) and "2024-03-02 07:00:00" in text
    empty = a.export("clicks", keyword="nothing").decode("utf-8-sig")
    assert empty == ",".join(usage.EXPORTS["clicks"]) + "\r\n"
    found = json.loads(a.export("daily", "json"))
    assert found["items"][0]["date"] == "2024-03-01" and found["dataset"] == "daily" and found["generated_at"].endswith("Z")
    with pytest.raises(ValueError):
        a.export("other")


def test_empty_log(log):
    none = log.filter("id < 0")
    assert usage.overview(none, ingest.unique_clicks(none)).first()[:] == (0, 0, 0, 0, 0)
    assert usage.daily(none).collect() == [] and usage.search_export(none, ingest.unique_clicks(none)).collect() == []


def test_clamps():
    assert usage.clamp(None, 20, 1, 200) == 20 and usage.clamp(999, 20, 1, 200) == 200 and usage.clamp(-3, 20, 1, 200) == 1


def test_formats(spark):
    p = source.papers(spark.createDataFrame([(1, "T", "A B#; ;C", 2020, "884", "884-890", None, "J. Eye")], "paper_id int, title string, authors string, year int, page_start string, pages string, page_end string, journal string"))
    ris = export.ris(p).first().ris
    assert ris == "TY  - JOUR\r\nTI  - T\r\nAU  - A B\r\nAU  - C\r\nJO  - Eye\r\nT2  - Eye\r\nPY  - 2020\r\nSP  - 884\r\nSP  - 884-890\r\nER  -\r\n"
    assert export.enw(p).first().enw == "﻿%0 Journal Article\r\n%T T\r\n%B Eye\r\n%D 2020\r\n%P 884-890\r\n%A A B\r\n%A C\r\n\r\n"
    assert "引用:\n（暂无）" in export.plain_text(p).first().text


def test_embeddings_are_built_once(spark):
    p = source.papers(spark.createDataFrame([(1, "T", "k"), (2, "U", None)], "paper_id int, title string, keywords string"))
    none = spark.createDataFrame([], "paper_id bigint, provider string, model string, dimensions int, text_hash string, embedding_blob binary, updated_at timestamp_ntz")
    pending = source.pending_embeddings(none, p, "api", "m", 2)
    assert {r.text for r in pending.collect()} == {"T\nKeywords: k", "U\nKeywords:"}
    made = source.embed(pending, lambda texts: [[float(len(t)), 0.0] for t in texts], "api", "m", 2, 1)
    stored = source.upsert_embeddings(none, made).cache()
    assert source.pending_embeddings(stored, p, "api", "m", 2).collect() == []
    assert source.freshness(stored, p, "api", "m", 2).first()[:] == (2, 2, 0)
    assert source.fresh_embeddings(stored, p, "api", "m", 2).count() == 2


def test_addresses(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "3", "4"), ("", "3", "4"), (None, None, "4")], "x_forwarded_for string, x_real_ip string, peer string")
    assert [r.client for r in ingest.client_address(df).collect()] == ["1.1.1.1", "3", "4"]


def test_streams(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    source_ = streams.event_stream(spark, str(tmp_path / "log"))
    streams.append_stream(streams.unique_click_stream(source_), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.search_event_id, r.paper_id) for r in got.collect()} == {(1, 5), (77, 6)}
    query = streams.daily_stream(source_).writeStream.format("memory").queryName("daily_test").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("daily_test").first().searches == 1


def test_log_is_partitioned_by_day(log, tmp_path):
    ingest.append_events(log, str(tmp_path / "e"))
    assert (tmp_path / "e" / "day=2024-03-01").exists()
