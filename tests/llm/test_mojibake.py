import random

import numpy as np
import pytest

from ocellus.llm import mojibake
from ocellus.llm.encodings import CHAINS, garble, restore
from ocellus.llm.mojibake import LOST_CLASS, Model, find_garbled, repair, restored, suspicious, train
from tests.llm.texts import corpus, text


@pytest.fixture(scope="module")
def model():
    return train([t for _, t in corpus(1, 1200)], 400)


ROUND = [((("utf-8", "cp1252"),), "de"), ((("utf-8", "latin-1"),), "fr"), ((("utf-8", "cp1251"),), "es"), ((("utf-8", "mac_roman"),), "pt"), ((("utf-8", "cp437"),), "de"), ((("utf-8", "cp1252"), ("utf-8", "cp1252")), "fr"), ((("gb18030", "latin-1"),), "zh"), ((("utf-8", "latin-1"),), "zh")]


@pytest.mark.parametrize("chain, language", ROUND)
def test_chains_invert(chain, language):
    t = text(random.Random(2), language)
    assert restore(garble(t, chain), chain) == t


@pytest.mark.parametrize("chain, language", ROUND)
def test_held_out_texts_are_found_and_restored(model, chain, language):
    r = random.Random(9)
    clean = [text(r, language) for _ in range(40)]
    rows = repair([garble(t, chain) for t in clean], model)
    assert sum(x[0] for x in rows) >= 39
    assert sum(x[4] == t for x, t in zip(rows, clean)) >= 36


def test_held_out_clean_texts_stay(model):
    clean = [t for _, t in corpus(77, 600)]
    rows = repair(clean, model)
    assert sum(x[0] for x in rows) <= 3
    assert all(x[4] == t for x, t in zip(rows, clean) if not x[0])


def test_a_short_passage_in_a_long_text(model):
    long = text(random.Random(4), "en", 400)
    rows = repair([long + " patientâ€™s " + long, long + " r�sultats", long], model)
    assert [x[0] for x in rows] == [True, True, False] and rows[0][4] == long + " patient’s " + long


def test_correct_but_rare_characters(model):
    odd = ["MÉTODOS E AVALIAÇÃO", "résultats", "\\u00e9 &eacute;", "10⁻³ 👁️ ① Ω", "ascii only", "", None, "   "]
    assert not any(x[0] for x in repair(odd, model)[2:])


def test_frame(spark):
    rows = [(i, t, "x") for i, (_, t) in enumerate(corpus(3, 300))]
    rows += [(900, garble(rows[0][1] + " für die Prüfung", (("utf-8", "cp1252"),)), None), (901, None, None), (902, "", None), (900, "plain", None), (None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, garbled string")
    got = find_garbled(df, sample=300, garbled=100).collect()
    assert len(got) == len(rows)
    assert [r.n_passages > 0 for r in got if r.doc_id == 900 and r.garbled] == [True]
    assert find_garbled(df.limit(0)).collect() == []
    assert len(CHAINS) > 30


def test_characters_that_the_sample_has_not(spark, monkeypatch):
    texts = dict(enumerate(t for _, t in corpus(5, 900)))
    own = mojibake.training_sample
    seen = []
    monkeypatch.setattr(mojibake, "training_sample", lambda *a: seen.append(own(*a)) or seen[-1])
    find_garbled(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), sample=300, garbled=100)
    outside = [i for i in range(900) if texts[i] not in seen[0]]
    monkeypatch.setattr(mojibake, "training_sample", lambda *a: seen[0])
    rare = "两组眼压的变化与鼙鼓龃龉无关，差异无统计学意义。"
    for i in outside[:3]:
        texts[i] = "随访期间未见严重不良反应。" + rare
    chain = (("gb18030", "latin-1"),)
    texts[900] = garble(rare, chain)
    for i in outside[3:6]:
        texts[i] = "Die Öffnung war ÜBERALL gleich groß. " * 2
    texts[outside[6]] = "随访期间未见严重不良反应…。请勿自行停药…，原因不明。"
    df = spark.createDataFrame(list(texts.items()) + [(901, "鼙鼓")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in find_garbled(df, sample=300, garbled=100).collect()}
    assert got[900].garbled and got[900].repaired == rare
    assert not any(got[i].garbled for i in outside[:7])


def test_a_single_chinese_character_beside_a_restored_passage(model):
    chain = (("gb18030", "latin-1"),)
    t = "两组眼压的变化无统计学意义 眼 a scan showed a thickness"
    rows = repair([garble(t, chain), garble("眼", chain) + " a scan showed a thickness"], model)
    assert rows[0][4] == t and rows[0][2] == rows[0][3] == 2
    assert not rows[1][0]


def test_every_chain_within_the_window_is_tried():
    word = garble("für", (("utf-8", "cp1252"),))
    right = CHAINS.index((("utf-8", "cp1252"),))
    wrong = [c for c in range(len(CHAINS)) if restored(word, c, Model(np.zeros((1, 1)))) is None][:6]

    class Scored(Model):
        def judge(self, own):
            scores = np.zeros((len(own), LOST_CLASS + 1))
            for i in [i for i, w in enumerate(own) if w == word.encode()]:
                scores[i, wrong], scores[i, right] = 20, 15
            return scores, np.full(len(own), 7.0), np.zeros(len(own))

        def clean(self, own):
            return np.zeros(len(own))

    assert repair([word], Scored(np.zeros((1, 1))))[0][4] == "für"


def test_the_length_of_training_texts_is_a_parameter(spark, monkeypatch):
    seen, own = [], mojibake.training_sample
    monkeypatch.setattr(mojibake, "training_sample", lambda *a: seen.append(own(*a)) or seen[-1])
    mojibake.find_garbled(spark.createDataFrame([(1, "aé " * 50)], "doc_id bigint, text string"), longest=40)
    assert [len(r) for r in seen[0]] == [40]


FRENCH = ["Le traitement n’a pas changé l’épaisseur.", "L’œil droit n’a pas été traité.", "L’étude n’a trouvé aucun cas d’œdème.", "Aucun œil n’a perdu d’acuité.", "S’il n’a pas mal à l’œil, l’équipe s’arrête là.", "Une sœur « âgée » de l’élève."]


@pytest.mark.parametrize("seed", range(24))
def test_every_sample_leaves_correct_french_and_finds_the_garbled(seed):
    r = random.Random(seed)
    clean = [t for _, t in corpus(1000 + seed, 300)] + [" ".join(r.choice(FRENCH) for _ in range(3)) for _ in range(60)]
    hidden = [" ".join(r.choice(FRENCH) for _ in range(3)) for _ in range(40)] + [text(r, x) for x in ("de", "es", "pt", "fr") for _ in range(25)]
    chains = [CHAINS.index(x) for x in ((("utf-8", "cp1252"),), (("utf-8", "mac_roman"),), (("cp1252", "mac_roman"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")))]
    bad = [garble(x, CHAINS[r.choice(chains)]) for x in hidden]
    mixed = clean + bad[::35]
    r.shuffle(mixed)
    model = train(mixed, 200)
    model.counts = np.zeros(1 << mojibake.WORD_BITS, np.int64)
    mojibake.census(mixed, model, model.counts)
    found, kept = repair(bad, model), repair(hidden + clean, model)
    true = sum(a != b for a, b in zip(bad, hidden))
    hits = sum(x[0] for x in found)
    assert hits >= 0.98 * true
    assert not [x[4] for x in kept if x[0]]


def test_apostrophes_and_quotes_are_no_signs_of_garbling():
    assert not any(map(suspicious, [*FRENCH, "Œdème « léger »", "andré »", "MÉTODOS E AVALIAÇÃO"]))
    assert all(map(suspicious, ["fÃ¼r", "a � b", "mm â€“ x", "Ã‡a", "çœ¼åŽ‹"]))


def test_lost_characters_have_a_class(model):
    rows = repair(["r�sultats", "ï¿½", "鈥� 52", "n�a pas", "眼压�升高", "na�ve", "é"], model)
    assert [x[0] for x in rows] == [True] * 6 + [False]
    assert rows[0][4] == "r�sultats" and rows[1][3] == 0
    assert repair(["a � b"], train(["only ascii"], 10))[0][:2] == (True, "lost")


def test_counts_of_words_decide_what_the_score_leaves_open(model):
    word = "aprËs"
    counts = np.zeros_like(model.counts)
    counts[mojibake.word_bucket(word.encode())] = 400
    assert not repair([word], Model(model.logs, model.known, counts))[0][0]
    counts[mojibake.word_bucket("après".encode())] = 4_000_000
    assert repair([word], Model(model.logs, model.known | {"è"}, counts))[0][4] == "après"


def test_portions_give_the_same(model, monkeypatch):
    own = list(dict.fromkeys(w for _, t in corpus(8, 200) for w in mojibake.words([t, garble(t, (("utf-8", "cp1252"),))])[0]))
    whole = model.judge(own)
    for size in (1, 50, 4000):
        monkeypatch.setattr(mojibake, "PORTION", size)
        assert all(np.allclose(a, b) for a, b in zip(whole, model.judge(own)))


def test_a_very_long_text(model):
    long = "检查发现中心凹附近厚度为" * 40_000
    rows = repair([long, long + " fÃ¼r " + long, "é" * 300_000], model)
    assert [x[0] for x in rows][:2] == [False, True] and rows[1][4] == long + " für " + long
