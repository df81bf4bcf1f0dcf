import random

import numpy as np
import pytest

from ocellus.llm import language
from ocellus.llm.encodings import garble
from ocellus.llm.language import affected, language_of, languages_of, text_languages, text_segments, train
from tests.llm.texts import SENTENCES, corpus, text

SCHEMA = "field string, record_id bigint, text string, label string, lang string"


def noisy(seed, n):
    r = random.Random(seed)
    return [(t, r.choice([*SENTENCES]) if r.random() < 0.1 else None if r.random() < 0.05 else lang, False) for lang, t in corpus(seed, n)]


@pytest.fixture(scope="module")
def model():
    return train(noisy(1, 900), 20)


def found(model, texts, query=False):
    return [[x for x, _ in row] for row in languages_of(texts, np.full(len(texts), query), model)]


def test_held_out_accuracy(model):
    rows = corpus(50, 500)
    got = found(model, [t for _, t in rows])
    assert sum(g == [lang] for g, (lang, _) in zip(got, rows)) >= 495


def test_mixed_texts(model):
    r = random.Random(8)
    for a, b in (("en", "zh"), ("de", "fr"), ("es", "pt"), ("zh", "de")):
        texts = [text(r, a, 5) + " " + text(r, b, 4) for _ in range(20)]
        assert sum(set(g) == {a, b} for g in found(model, texts)) >= 18


def test_names_in_a_text_do_not_count(model):
    assert found(model, ["Gisdri中心曾两次更换Ostkel-24设备，因此前后数据分开分析。"]) == [["zh"]]


def test_queries_change_script(model):
    assert [set(x) for x in found(model, ["学龄儿童视力的变化 the patient symptoms after surgery", "OCT 眼压"], True)][0] == {"zh", "en"}


def test_garbled_texts_have_the_language_of_their_original(model):
    r = random.Random(3)
    for lang, chain in (("zh", (("utf-8", "cp1252"),)), ("zh", (("gb18030", "utf-8"),)), ("fr", (("utf-8", "cp1251"),)), ("de", (("cp1252", "utf-8"),))):
        got = found(model, [garble(text(r, lang, 5), chain) for _ in range(20)])
        assert sum(g == [lang] for g in got) >= 18, (lang, chain)


def test_labels():
    assert [language_of(x) for x in ("EN", "en-GB", "zh_CN", "Chinese", "ger", "pt-BR", "und", "??", "", None, " unknown ", "it")] == ["en", "en", "zh", "zh", "de", "pt", None, None, None, None, None, "other"]


def test_frames(spark):
    rows = [("document", i, t, label, "x") for i, (t, label, _) in enumerate(noisy(4, 400))]
    rows += [("document", 1000, None, None, None), ("document", 1001, "  ", None, None), ("title", 1002, "12 + 3", None, None), ("document", 1003, text(random.Random(1), "fr", 5), "it", None), ("document", 1004, text(random.Random(1), "de", 5) + " " + text(random.Random(2), "en", 5), "German", None), ("document", 1005, text(random.Random(6), "es", 300), "es_MX", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    labelled = text_languages(df, sample=400, garbled=5).cache()
    assert labelled.count() == len(rows)
    bad = {}
    for r in affected(labelled).collect():
        bad.setdefault(r.record_id, set()).add(r.lang)
    assert not {1000, 1001, 1002, 1005} & set(bad) and bad[1003] == {"fr"} and bad[1004] == {"de", "en"}
    parts = text_segments(df.filter("record_id = 1004"), sample=400, garbled=5)
    assert parts.count() >= 2 and parts.filter("confidence < 0 or confidence > 1 or n_chars < 1").count() == 0
    assert text_languages(df.limit(0)).collect() == [] and text_segments(df.limit(0)).collect() == []


def test_long_texts_are_taken_in_pieces(model, monkeypatch):
    import ocellus.llm.language as language

    r = random.Random(5)
    texts = [text(r, "fr", 60) + " " + text(r, "en", 60), "a 1 b 2 c 3 " * 400]
    before = [languages_of([t], np.array([False]), model) for t in texts]
    monkeypatch.setattr(language, "PIECE", 500)
    after = [languages_of([t], np.array([False]), model) for t in texts]
    assert [[x for x, _ in b[0]] for b in before] == [[x for x, _ in a[0]] for a in after]
    s, lengths, *_ = language.segments_of([texts[0]], np.array([False]), model)
    assert lengths.sum() == len(texts[0]) and (np.diff(s.offset) > 0).all()


def test_the_length_of_training_texts_is_a_parameter(spark, monkeypatch):
    seen, own = [], language.training_rows
    monkeypatch.setattr(language, "training_rows", lambda *a: seen.append(own(*a)) or seen[-1])
    language.text_languages(spark.createDataFrame([("document", 1, "abc " * 50, "en")], "field string, record_id bigint, text string, label string"), longest=40)
    assert [len(r[0]) for r in seen[0]] == [40]


def test_long_texts_have_the_segments_of_the_whole(model, monkeypatch):
    r = random.Random(12)
    long = " ".join(text(r, x, 3) for x in ("de", "en", "zh", "fr") * 12) + " a.b c\u3000d! e"
    one = np.zeros(1, bool)
    whole = language.segments_of([long], one, model)
    monkeypatch.setattr(language, "PIECE", 90)
    parts = language.segments_of([long], one, model)
    assert (whole[0].offset == parts[0].offset).all() and all((a == b).all() for a, b in zip(whole[1:3], parts[1:3]))
    assert np.allclose(whole[3], parts[3])
