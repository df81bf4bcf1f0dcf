import pytest

from ocellus.llm.mixing import Quota, fill, mixture, shares

TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, sizes):
    rows = [(i, s, "eye " * (1 + i % 40)) for s, n in sizes.items() for i in range(hash_base(s), hash_base(s) + n)]
    rows += [(-1, None, "eye"), (-2, "unlisted", "eye eye"), (-3, "a", None), (-4, "a", ""), (-5, "b", None)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def hash_base(s):
    return {"a": 0, "b": 100_000, "c": 200_000}[s]


def test_shares_are_met_and_repeats_bounded(spark):
    docs = corpus(spark, {"a": 2000, "b": 300, "c": 60})
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("none", 0.0, 1), (None, 0.5, 1)], TARGETS)
    mixed = mixture(docs, targets, block_tokens=64).cache()
    got = {r.source: r for r in shares(mixed, targets).collect()}
    for s, share, repeats in (("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 3)):
        assert got[s].actual_share == pytest.approx(share, abs=0.015)
        assert got[s].most_repeats <= repeats
    rows = mixed.collect()
    assert len({(r.doc_id, r["repeat"]) for r in rows}) == len(rows) and all(r.n_tokens > 0 for r in rows)
    half = sorted(r.slot for r in rows)[len(rows) // 2]
    early = [r for r in rows if r.slot < half]
    assert sum(r.n_tokens for r in early if r.source == "a") / sum(r.n_tokens for r in early) == pytest.approx(0.6, abs=0.05)


def test_a_total_beyond_what_repeats_allow(spark):
    docs = corpus(spark, {"a": 1000, "b": 50})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("missing", 0.2, 9)], TARGETS)
    mixed = mixture(docs, targets, total_tokens=15_000, block_tokens=32)
    got = {r.source: r for r in shares(mixed, targets).collect()}
    assert got["b"].most_repeats == 2 and got["b"].n_documents == 100 and got["missing"].tokens == 0
    assert got["a"].tokens + got["b"].tokens == pytest.approx(15_000, rel=0.03)


def test_a_scarce_source_does_not_shrink_the_mixture(spark):
    docs = corpus(spark, {"a": 2000, "b": 1500, "c": 3})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 4)], TARGETS)
    mixed = mixture(docs, targets, block_tokens=64, passes=1).cache()
    got = {r.source: r for r in shares(mixed, targets).collect()}
    size = sum(len(r.text.split()) for r in docs.filter("source in ('a', 'b', 'c') and text <> ''").collect())
    whole = sum(r.tokens for r in got.values())
    assert whole == pytest.approx(size, rel=0.05)
    assert got["c"].n_documents == 12 and got["c"].most_repeats == 4
    assert got["c"].missing_tokens == pytest.approx(0.1 * whole - got["c"].tokens, abs=1) and got["c"].missing_tokens > 0
    assert got["a"].tokens / got["b"].tokens == pytest.approx(0.5 / 0.4, rel=0.05) and got["a"].most_repeats == 1


def test_filling():
    q = [Quota("a", 0.5, 1, 100), Quota("b", 0.5, 2, 10)]
    assert fill(q, None) == pytest.approx(40) and [x.tokens for x in q] == [20, 20]
    assert fill(q, 100) == pytest.approx(100) and [x.tokens for x in q] == [80, 20]
    assert fill(q, 1000) == pytest.approx(120) and fill([], None) == 0


def test_empty(spark):
    docs = corpus(spark, {})
    targets = spark.createDataFrame([("c", 1.0, 1)], TARGETS)
    assert mixture(docs, targets).collect() == []
    assert mixture(docs.limit(0), targets.limit(0)).collect() == []


def test_hundreds_of_sources(spark):
    rows = [(i, f"s{i % 400}", "eye " * (1 + i % 7)) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([(f"s{i}", 1.0 / 400, 2) for i in range(400)], TARGETS)
    got = shares(mixture(docs, targets, block_tokens=8, passes=1), targets).collect()
    assert len(got) == 400 and all(r.n_documents > 0 and r.most_repeats <= 2 for r in got)
