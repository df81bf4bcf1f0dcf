import sqlite3

import pytest

from ocellus.operators import fulltext
from ocellus.sources.papers import papers

DOCS = [
    (1, "Dry eye in rural adults", "Li Wei; Ann Lee", "dry eye, cornea", "A study of dry eyes and the eye. Élan.", 2010),
    (2, "Corneal haze", None, None, "Haze of the cornea after surgery; no dry spell", 2012),
    (3, "白内障手术", "王芳", "白内障", "干眼 与 白内障 eye", None),
    (4, "Eye", "", "", "", 0),
    (5, None, None, None, None, 2020),
    (6, "Outcomes of eye surgery: corneal haze", "A", "haze; eye", "eye eye eye dry " * 30, 2021),
]
QUERIES = ["dry eye", "dry OR haze", "eye NOT dry", "corn*", '"corneal haze"', "title: eye", "{title keywords}: haze", "- abstract: eye", "^outcomes", "^eye", "dry + eye", "age-related", "what is?", "dry AND", "白内障", "干眼 OR haze", "elan", "a AND b OR eye NOT haze", "(dry OR haze) AND eye", "(dry OR haze) eye", "eye_surgery", "？ eye", "(eye", "* eye", 'say "x', "NEAR(haze cornea, 2)", "NEAR(eye surgery haze, 3)", "NEAR(haze surgery, 2) OR dry", 'NEAR("corneal haze" eye sur*, 4)', "title: NEAR(eye haze, 3)", "NEAR(eye dry, 1)", "NEAR(eye eye dry, 2) NOT cornea", '"eye eye"', '"dry ey"*', '^"dry eye"', "corn* sur* NOT cataract"]


@pytest.fixture(scope="module")
def both(spark):
    rows = [(i, t, a, k, x, y) for i, t, a, k, x, y in DOCS]
    typed = papers(spark.createDataFrame(rows, "paper_id int, title string, authors_display string, keywords_text string, abstract_text string, publication_year int"))
    conn = sqlite3.connect(":memory:")
    conn.execute("create virtual table f using fts5(paper_id unindexed, title, authors, keywords, abstract)")
    conn.executemany("insert into f values (?, ?, ?, ?, ?)", [(r.id, r.title, " ".join(r.authors), " ".join(r.keywords), r.abstract) for r in typed.collect()])
    index = fulltext.token_index(typed).cache()
    return index, conn, fulltext.postings(index).cache()


@pytest.mark.parametrize("query", QUERIES)
def test_scores_are_those_of_sqlite(both, query):
    index, conn, posted = both
    sql = "select paper_id, -bm25(f) from f where f match ?"
    try:
        want = dict(conn.execute(sql, (query,)).fetchall())
    except sqlite3.OperationalError:
        want = dict(conn.execute(sql, ('"' + query.replace('"', '""') + '"',)).fetchall())
    for found in (fulltext.bm25_raw(index, query), fulltext.bm25_posted(posted, fulltext.corpus_stats(index), query)):
        got = {r.id: r.score for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_near(both):
    assert {r.id for r in fulltext.bm25_raw(both[0], "NEAR(haze cornea, 2)").collect()} == {2}
    assert {r.id for r in fulltext.bm25_raw(both[0], "NEAR(haze surgery, 2)").collect()} == {6}


def test_normalised_scores(both):
    scores = [r.score for r in fulltext.full_text(both[0], "eye").collect()]
    assert max(scores) == 1.0 and min(scores) == 0.0 and scores == sorted(scores, reverse=True)
    assert [r.score for r in fulltext.full_text(both[0], "白内障").collect()] == [1.0]
    assert fulltext.full_text(both[0], "  ").collect() == [] and fulltext.full_text(both[0], "？").collect() == []


def test_postings_give_the_same(both):
    index, *_ = both
    a = {r.id: round(r.score, 9) for r in fulltext.bm25_of_words(fulltext.postings(index), fulltext.corpus_stats(index), ["dry", "eye"]).collect()}
    b = {r.id: round(r.score, 9) for r in fulltext.bm25_raw(index, "dry eye").collect()}
    assert a == b and a


def test_empty_corpus(spark, both):
    none = both[0].filter("id < 0")
    assert fulltext.full_text(none, "eye").collect() == []
