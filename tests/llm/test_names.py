import itertools
import random

import pytest

from ocellus.llm.names import evidence, fold, near, near_spots, parse, readings, resolve, splits, SYLLABLES, variant_pairs
from pyspark.sql import functions as F

PEOPLE = [
    ["Shayun He(贺莎沄)", "(贺莎沄)He Shayun", "He SY", "Sha-Yun He", "shayun  he", "Dr Shayun He#", "贺 莎沄", "He Shayunn", "Shayun HE"],
    ["Ruilan Rao(饶瑞兰)", "Ruilan Rao（饶瑞蘭）"],
    ["Ruilan Rao(饶瑞岚)"],
    ["Ottilie J. Tarlholm", "Tarlholm O. J.", "TARLHOLM Ottilie", "Tilly Tarlholm", "Ottile Tarlholm", "Prof. Ottilie Tarlholm"],
    ["Zachary Büchholm", "Buechholm Zachary", "Zachary Buchholm PhD", "Z. Büchholm", "Zachaery Büchholm"],
    ["Mallo Low Vision Network (MLVN) Study Group", "MLVN Study Group", "The Mallo Low Vision Network Study Group", "Study Group of the Mallo Low Vision Network", "Mallo Low Vision Netw. Study Group", "Mallo Low Vsion Network Investigators"],
]
# others, so that syllables, surnames and given names are known
OTHERS = ["Sha He(贺莎)", "Yun He(贺沄)", "Yunsha Wang(王沄莎)", "Lan Rao(饶兰)", "Rui Wang(王瑞)", "Lanrui Rao(饶兰瑞)", "Ottilie Ambrgate", "Zachary Ambrgate", "Ottilie Weiksen", "Zachary Weiksen", "Ottilie Fennini", "Zachary Fennini", "Mallo Cataract Trial Study Group", "Sorba Low Vision Network Study Group", "Sorba Low Vision Trial Study Group"]


def test_people(spark):
    rows = [("; ".join(group),) for group in zip(*itertools.zip_longest(*PEOPLE, fillvalue=""))] + [(x,) for x in OTHERS] + [(None,), ("",), (" ;, \n",), ("Shayun He(贺莎沄)",), ("?!",)]
    df = spark.createDataFrame(rows, "authors_display string").withColumn("name", F.lit("clash"))
    resolved = resolve(df).cache()
    assert resolved.count() == resolved.select("name").distinct().count() == sum(map(len, PEOPLE)) + len(OTHERS) + 1
    got = {(r.name_a, r.name_b) for r in variant_pairs(resolved).collect()}
    want = {tuple(sorted(p)) for group in PEOPLE for p in itertools.combinations(group, 2)}
    assert got - want == set()
    assert len(got & want) >= 0.9 * len(want), want - got


def test_more_recurring_tokens_than_any_limit(spark):
    tokens = ["".join(x) for x in itertools.islice(itertools.product("abcdefgh", repeat=5), 20_100)]
    rows = []
    for i in range(0, len(tokens), 20):
        own = tokens[i : i + 20]
        rows += [(" ".join(own[k:] + own[:k]) + " Study Group",) for k in (0, 7, 13)]
    people = ["Zyltan Zorvath", "Zyltan Zorvatt", "Zyltan Zorvats", "Mirko Zorvath", "Petra Zorvath"]
    df = spark.createDataFrame(rows + [(x,) for x in people], "authors_display string")
    entity = {r.name: r.entity for r in resolve(df).filter(F.col("name").isin(*people)).collect()}
    assert entity["Zyltan Zorvath"] == entity["Zyltan Zorvatt"] == entity["Zyltan Zorvats"]
    assert len(set(entity.values())) == 3


def test_merging_never_stops_silently(spark):
    df = spark.createDataFrame([("Ottilie Tarlholm; Tarlholm Ottilie",)], "authors_display string")
    with pytest.raises(RuntimeError):
        resolve(df, rounds=0)
    assert resolve(df, rounds=1).select("entity").distinct().count() == 1


def test_no_names(spark):
    df = spark.createDataFrame([(None,), ("",)], "authors_display string")
    assert resolve(df).collect() == []


def test_parsing():
    assert fold("Büchholm") == fold("Buechholm") == "buchholm" and fold("Nørholm") == "norholm" and fold("Xue") == "xue"
    assert fold("Xuefeng") == "xuefeng" and fold("Mueller") == "muller" and parse("Rboert Kroeini").plain == ["rboert", "kroeini"]
    assert parse("NI Daixu").tokens == ["ni", "daixu"] and parse("Gong YK").initials == "yk" and parse("卓 沛笙").han == "卓沛笙"
    assert parse("Tao DR").initials == "dr" and parse("Dr Tao").initials == "" and parse("Li Tao MD").tokens == ["li", "tao"]
    assert parse("Study Group of the Sortar Cataract Survey").tokens == ["sortar", "cataract", "survey"] and parse("").tokens == []
    assert parse("Hengfeng Yi(易衡峯)").han == parse("易衡峰").han and parse("勗").han == "勖"
    assert splits("shayun", SYLLABLES) == [["sha", "yun"]] and splits("kaaize", SYLLABLES) == [] and ["xian"] in splits("xian", SYLLABLES)


def test_typing_errors(spark):
    pairs = [("shayun", "shayun"), ("shayun", "shayn"), ("shayun", "shaynu"), ("shayun", "shaxun"), ("shayun", "shax"), ("abc", "cba")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(near(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, False, True]


def test_a_chain_of_fifty_spellings(spark):
    r = random.Random(4)
    w = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(104))
    names = [f"{w[:k]} {w[k : k + 2]} {w[k + 2 :]}" for k in range(3, 102, 2)]
    df = spark.createDataFrame([(x,) for x in [*names, "Petra Zorvath"]], "authors_display string")
    entity = {r.name: r.entity for r in resolve(df).collect()}
    assert len(names) == 50 and len({entity[x] for x in names}) == 1 and len(set(entity.values())) == 2


def test_a_name_in_five_thousand_spellings(spark):
    r = random.Random(5)
    names = {"".join(r.choice((c.lower(), c.upper())) for c in "Ottilie Tarlholm") for _ in range(5000)}
    df = spark.createDataFrame([(x,) for x in names], "authors_display string")
    assert len(names) > 4500 and resolve(df).select("entity").distinct().count() == 1


def test_tokens_are_paired_once_and_never_with_themselves(spark):
    rows = [(i, "typo", f"ada {d}", t) for i, t in enumerate(["zorvath"] * 30 + ["zorvat"] * 20) for d in {t} | {t[:k] + t[k + 1 :] for k in range(len(t))}]
    flat = spark.createDataFrame(rows, "id bigint, type string, key string, token string")
    assert near_spots(flat).count() == 2


def test_longer_given_names_and_surnames_of_two_characters():
    assert ("syllable", "fei", "欧阳兰菲") in evidence("Lanfei Ouyang(欧阳兰菲)") and ("syllable", "lan", "何莎沄兰") in evidence("Shayunlan He(何莎沄兰)")
    assert readings("shayunlan", SYLLABLES, "") == [["sha", "yun", "lan"]] and readings("shayun", SYLLABLES, "") == [["sha", "yun"]]
