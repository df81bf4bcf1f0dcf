from ocellus.llm.sampling import hash_sample, hash_samples, pieces


def test_samples_are_those_of_least_hash(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = [r.k for r in hash_sample(df, "k", 50, 1)]
    from pyspark.sql import functions as F

    assert a == [r.k for r in df.orderBy(F.xxhash64(F.lit(1), "k"), "k").limit(50).collect()]
    assert len(hash_sample(df.limit(7), "k", 50, 1)) == 7 and hash_sample(df.limit(0), "k", 5, 1) == []


def test_rows_with_one_key_or_all_the_same_fill_the_sample(spark):
    df = spark.range(5000).selectExpr("cast(null as bigint) k", "cast(id as string) t")
    assert len({r.t for r in hash_sample(df, "k", 40, 1)}) == 40
    same = spark.range(5000).selectExpr("1 k", "'a' t", "'g' g")
    assert len(hash_sample(same, "k", 40, 1)) == 40 and len(hash_samples(same, "g", ("g",), "k", 40, 1)) == 40


def test_pieces():
    assert pieces("ab cd ef", 2, lambda a, b: b == " ") == ["ab", " cd", " ef"]
    assert pieces("abcdef", 2, lambda a, b: False) == ["abcdef"] and pieces("", 2, lambda a, b: True) == [""]


def test_samples_of_groups(spark):
    df = spark.range(9000).selectExpr("id k", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' else 'c' end g", "1 n")
    got = {}
    for r in hash_samples(df, "g", ("a", "b", "none"), "k", 40, 1):
        got.setdefault(r.g, []).append(r.k)
    assert set(got) == {"a", "b"} and got["a"] == [r.k for r in hash_sample(df.filter("g = 'a'"), "k", 40, 1)]
