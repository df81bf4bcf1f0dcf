import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ocellus.llm.frequent import frequent_values


def run(spark, values, support, **options):
    df = spark.createDataFrame([(v, 1) for v in values], "q string, n_rows int")
    return {r.q: r.n_rows for r in frequent_values(df, "q", support, **options).collect()}


def brute(values, support):
    counts = Counter(v for v in values if v is not None)
    n = sum(counts.values())
    return {v: c for v, c in counts.items() if c >= support * n}


def test_skewed_values(spark):
    r = random.Random(1)
    values = ["hot"] * 3000 + [f"v{r.randrange(4000)}" for _ in range(4000)] + ["mid"] * 90 + [None] * 500 + [""] * 60 + ["x" * 5000] * 45
    for buckets in (4, 64, 8192):  # few buckets let more values through, never fewer
        assert run(spark, values, 0.006, buckets=buckets) == brute(values, 0.006)


def test_the_threshold_itself_counts(spark):
    assert run(spark, ["a"] * 6 + [str(i) for i in range(994)], "0.006") == {"a": 6}
    assert run(spark, ["a"] * 5 + [str(i) for i in range(995)], "0.006") == {}


def test_ties_and_empty(spark):
    assert run(spark, ["a", "b"], 0.5) == {"a": 1, "b": 1}
    assert run(spark, [], 0.5) == {} and run(spark, [None, None], 0.5) == {}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from("abcdef"), st.text(max_size=3)), max_size=60))
def test_random(spark, values):
    assert run(spark, values, 0.1, buckets=8) == brute(values, 0.1)


def test_p2_leaves_out_blank_values(spark, tmp_path):
    from ocellus.llm.queries import p2_found

    spark.createDataFrame([("a",)] * 5 + [("",)] * 5 + [("　 ",)] * 5 + [(None,)], "query_normalized string").withColumn("id", F.lit(1)).write.parquet(str(tmp_path / "analytics_events.parquet"))
    assert [r[0] for r in p2_found(spark, str(tmp_path)).collect()] == ["a"]
