import random

from pyspark.sql import functions as F

from ocellus.operators.scan import grouped_scan


def test_against_brute_force_with_a_hot_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + ["a", None, "b"]), i, r.choice([None, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {x.i: (x.n, x.before) for x in grouped_scan(df, ["g"], [F.col("i")], value="v", row="n", before="before", partitions=7).collect()}
    seen, want = {}, {}
    for g, i, v in rows:
        n, s = seen.get(g, (0, 0))
        want[i] = (n + 1, s)
        seen[g] = (n + 1, s + (v or 0))
    assert got == want


def test_without_value_and_descending(spark):
    df = spark.createDataFrame([(1, 3.0, 1), (1, 2.0, 2), (2, 9.0, 3)], "g int, x double, n int")
    got = {r.n: r.at for r in grouped_scan(df, ["g"], [F.col("x").desc()], row="at").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_empty(spark):
    assert grouped_scan(spark.createDataFrame([], "g int, x int"), ["g"], [F.col("x")], value="x").collect() == []
