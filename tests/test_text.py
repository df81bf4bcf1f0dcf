import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ocellus.functions.lexicon import expansions
from ocellus.functions.text import beijing_time, clean_author, clean_journal, highlight, matches, normalize_query, round4, snippet, split_list, text_matches, tokens, tokens_of

CASES = ["", None, "  Dry   EYE　", "a;b,, c\r\nd", "ÉLAN vital", "Straße_mit-Umlaut ä", "白内障手术。", "Février", "x'y\"z", "ÅØ ñ"]


def one(spark, column, rows=CASES):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_split_and_normalise(spark):
    assert one(spark, split_list("x"))[:4] == [[], [], ["Dry   EYE"], ["a", "b", "c", "d"]]
    assert one(spark, normalize_query("x"))[:3] == ["", "", "dry eye"]


def test_tokens_agree_with_python(spark):
    assert one(spark, tokens("x")) == [tokens_of(x or "") for x in CASES]
    assert tokens_of("ÉLAN vital") == ["elan", "vital"] and tokens_of("白内障手术。") == ["白内障手术"] and tokens_of("Straße_mit") == ["straße", "mit"]


@pytest.mark.parametrize("needle", ["oct", "eye d", "白内", "", "e"])
def test_matching_agrees_with_python(spark, needle):
    rows = ["OCT scan", "doctor", "oct2", "pre-oct", "白内障", None, "", "dry eye disease", "x e y"]
    assert one(spark, matches("x", needle), rows) == [text_matches(x, needle) for x in rows]


def test_cleaning(spark):
    assert one(spark, clean_author("x"), [" Li  Wei#, ", "#"]) == ["Li Wei", ""]
    assert one(spark, clean_journal("x"), ["Chin. J. Ophthalmol.", "Eye", None, " . ", "A. B"]) == ["Ophthalmol", "Eye", "", "", "B"]
    assert one(spark, snippet("x", 3, "..."), ["abcd", "abc", "", None]) == ["abc...", "abc", None, None]
    assert one(spark, highlight("x", "dry eye"), ["Dry Eye and dry"]) == ["<mark>Dry Eye</mark> and <mark>dry</mark>"]


def test_rounding_and_time(spark):
    assert spark.sql("select 0.12345D x, timestamp_ntz'2024-01-01 20:00:00' t").select(round4("x"), beijing_time("t")).first()[:] == (0.1235, "2024-01-02 04:00:00")


def test_expansions():
    assert expansions("白内障手术") == ["cataract", "cataract surgery", "congenital cataract"]
    assert expansions("oct") == ["optical coherence tomography", "光学相干断层扫描"]
    assert expansions("") == [] and expansions(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30), st.text(max_size=6))
def test_matching_never_fails(text, needle):
    assert text_matches(text, needle) in (True, False)
