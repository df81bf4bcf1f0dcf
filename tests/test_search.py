from datetime import date

import pytest

from ocellus.engine import Cache, Engine
from ocellus.operators import fusion, retrieval
from ocellus.plans import understanding as u
from ocellus.plans.providers import rewriter_from_chat
from ocellus.sources.papers import column_map, papers

TODAY = date(2026, 5, 1)
ROWS = [
    (1, "Dry eye in adults", "Jiaqing Zhang(张佳晴); Li Wei", "dry eye; cornea", "About dry eyes", "2010"),
    (2, "Cataract surgery outcomes", "王海燕#", "白内障\ncataract", "Phaco in OCT", "2020"),
    (3, "Doctors and glaucoma", "Wang Haiyan(王海燕)", "青光眼", "glaucoma drops", "2024"),
    (4, "OCT imaging", "O. Lee", "oct", "scan", "x"),
    (5, "", None, None, None, None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "ID int, Title string, author string, keywords string, `摘要` string, `年份` string")


@pytest.fixture(scope="module")
def typed(table):
    return papers(table).cache()


def scores(df):
    return {r.id: round(r.score, 6) for r in df.collect()}


def test_aliases(typed):
    assert column_map(["paper_id", "标题"])["id"] == "paper_id"
    assert [r.year for r in typed.orderBy("id").collect()] == [2010, 2020, 2024, None, None]
    assert typed.orderBy("id").first().authors == ["Jiaqing Zhang(张佳晴)", "Li Wei"]


def test_keyword_tiers(typed):
    assert scores(retrieval.by_keywords(typed, "Dry Eye")) == {1: 1.0}
    assert scores(retrieval.by_keywords(typed, "eye cornea")) == {1: 0.9}
    assert scores(retrieval.by_keywords(typed, "cornea drops")) == {1: 0.175}
    assert scores(retrieval.by_keywords(typed, "白内障手术")) == {2: 0.85}
    assert scores(retrieval.by_keywords(typed, "oct")) == {4: 1.0}
    assert scores(retrieval.by_keywords(typed, " ")) == {}


def test_author_tiers(typed):
    assert scores(retrieval.by_authors(typed, "li wei")) == {1: 1.0}
    assert scores(retrieval.by_authors(typed, "姓张")) == {1: 0.92}
    assert scores(retrieval.by_authors(typed, "王海燕")) == {2: 1.0, 3: 1.0}
    assert scores(retrieval.by_authors(typed, "wei chen")) == {1: 0.5}
    assert retrieval.knows_author(typed, "王 海燕") and not retrieval.knows_author(typed, "lee")


def test_terms(typed):
    assert scores(retrieval.by_terms(typed, "glaucoma oct")) == {2: 0.5, 3: 0.5, 4: 0.5}


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [1.0]), (5, None)], "id int, vector array<float>")
    assert scores(retrieval.nearest_arrays(v, [1.0, 0.0], 2)) == {1: 1.0, 2: 0.5}


def test_fusion_by_hand(spark):
    p = spark.createDataFrame([(1, "dry eye", [], [], "", 2015, None), (2, "x", [], [], "", 2010, None), (3, "y", [], [], "", 2020, None)], "id int, title string, authors array<string>, keywords array<string>, abstract string, year int, citation string")
    raw = spark.createDataFrame([(1, 1.0)], "id int, score double")
    rew = spark.createDataFrame([(1, 0.5), (9, 1.0)], "id int, score double")
    got = fusion.fuse(p, {"raw": raw, "rewrite": rew}, "dry eye").collect()
    assert [(r.id, r.final_score, r.hits, r.sources) for r in got] == [(1, 0.405, 2, ["raw_fts", "rewrite_fts"])]
    assert fusion.fuse(p, {"raw": raw}, "dry eye", year_from=2016).collect() == []
    assert fusion.script_of("OCT 检查") == "mixed" and fusion.script_of("检查") == "cjk"


def test_fusion_of_more_candidates_than_are_broadcast(spark):
    p = spark.range(3000).selectExpr("id", "'t' title", "array('a') authors", "array('k') keywords", "'' abstract", "2000 year", "cast(null as string) citation")
    raw = spark.range(3000).selectExpr("id", "1.0 score")
    assert fusion.fuse(p, {"raw": raw}, "q").count() == fusion.MOST and fusion.fuse(p, {"raw": raw}, "q", most=None).count() == 3000


def test_parsing():
    known = {"王海燕", "李伟", "smith"}.__contains__
    q = u.parse("近五年 dry eye 的研究", known, today=TODAY)
    assert (q.year_from, q.year_to, q.text) == (2021, 2026, "dry eye")
    assert u.parse("去年白内障", known, today=TODAY).year_from == 2025 and u.parse("近十二年", known, today=TODAY).year_from is None
    assert u.parse("x", known, 2001, None, today=TODAY).year_from == 2001
    q = u.parse("不要李伟作者的干眼症研究", known, today=TODAY)
    assert q.exclude == ["李伟"] and q.text == "干眼症"
    q = u.parse("glaucoma by smith", lambda n: n.lower() == "smith", today=TODAY)
    assert q.include == ["smith"] and q.text == "glaucoma"
    assert u.parse("王海燕的青光眼相关文章", known, today=TODAY).include == ["王海燕"]
    assert u.parse("", known).text == ""


def test_rewrites():
    assert u.rewrites("白内障手术", None)[:2] == ["cataract surgery", "congenital cataract"] and u.rewrite_limit("白内障手术") == 1
    assert u.rewrites("dry eye", u.Rewrite(zh=("干眼症治疗",), en=("ocular surface",)))[0]
    assert u.clean_candidate("x", "眼") == "" and u.clean_candidate("x", "a") == ""
    assert u.json_object('so: {"a": 1} end') == {"a": 1} and u.json_object("none") is None


SUGGESTED = u.Rewrite(zh=("干眼诊断", "干眼管理"), en=("tear film imaging", "meibography grading", "third form"), must=("eyelid",))


@pytest.mark.parametrize(
    "raw, want",
    [
        ("眼球震动", ["tear film imaging", "meibography grading"]),  # Chinese: the first English form leads, then the best of all English ones
        ("眼球 AI 震动", ["tear film imaging", "meibography grading"]),
        ("strabismus gene", ["meibography grading", "tear film imaging"]),  # English: by priority, of equal ones the earlier
        ("2024", ["tear film imaging", "meibography grading"]),
    ],
)
def test_rewrites_by_script(raw, want):
    got = u.rewrites(raw, SUGGESTED)
    assert len(got) == u.MAX_REWRITES and set(got) == set(want)
    assert got[0] == "tear film imaging" or not u.has_cjk(raw)


def test_what_each_script_is_offered():
    only = lambda **o: u.rewrites("qqq zzz", u.Rewrite(**o))
    assert only(zh=("眼前节成像", "眼后节成像", "第三个形式")) == ["眼前节成像", "眼后节成像"] and only(must=("first word", "second word")) == ["first word"]
    assert u.rewrites("震动", u.Rewrite(must=("first word",))) == [] and u.rewrites("震动", u.Rewrite(zh=("眼前节成像", "眼后节成像"))) == ["眼后节成像"]
    assert [u.script_of(x) for x in ("OCT 检查", "检查", "oct", "12")] == ["mixed", "han", "latin", "other"]


def test_a_failing_service_goes_off():
    calls = []

    def chat(query):
        calls.append(query)
        raise OSError

    rewrite = rewriter_from_chat(chat)
    assert rewrite("a") is None and rewrite("b") is None and calls == ["a"]


def test_search_end_to_end(table):
    engine = Engine(table)
    assert [r.id for r in engine.search("dry eye", today=TODAY).collect()][0] == 1
    assert {r.id for r in engine.search("王海燕的青光眼相关文章", today=TODAY).collect()} == {2, 3}
    assert [r.id for r in engine.search("oct", sort="most_recent", limit=2, today=TODAY).collect()][0] == 2
    assert engine.search("zzz qqq", today=TODAY).collect() == []
    assert engine.detail(3).first().title == "Doctors and glaucoma" and engine.detail(99).first() is None
    assert "AU  - 王海燕\r\n" in engine.ris(2).first().ris and engine.enw(2).first().enw.startswith("﻿%0 Journal Article\r\n")
    judged = Engine(table, judge=lambda q, rows: {rows[-1]["id"]: 1.0}).search("dry eye oct", today=TODAY)
    assert judged.filter("judge_score is not null").count() == 1
    with pytest.raises(ValueError):
        engine.search("")


def test_cache_forgets():
    c = Cache(seconds=100, entries=2)
    for i in range(3):
        c.put(i, i)
    assert c.get(0) is None and c.get(2) == 2
    c.seconds = -1
    assert c.get(2) is None


def test_a_prepared_engine_reads_only_the_postings_of_its_words(spark, table, tmp_path, capsys):
    Engine.prepare(table, None, str(tmp_path))
    with Engine.prepared(spark, str(tmp_path)) as engine:
        engine.matches('"dry eye" OR glauc*').explain()
    plan = capsys.readouterr().out
    assert "In(token, [dry,eye])" in plan and "StringStartsWith(token,glauc)" in plan and "tokens.parquet" not in plan


def test_a_judge_may_score_any_number(spark):
    scored = spark.range(3000).selectExpr("id", "0.5 final_score", "2000 year")
    judged = spark.range(2500).selectExpr("id", "1.0 judge_score")
    assert fusion.blend(scored, judged).filter("final_score > 0.6").count() == 2500


def test_a_prepared_engine_finds_the_same(spark, table, tmp_path):
    Engine.prepare(table, None, str(tmp_path))
    kept, written = Engine(table), Engine.prepared(spark, str(tmp_path))
    for text in ("dry eye", "王海燕的青光眼相关文章"):
        assert [r[:] for r in kept.search(text, today=TODAY).collect()] == [r[:] for r in written.search(text, today=TODAY).collect()]
    kept.close()
