import random

from ocellus.llm.leximin import SCORES, leximin

SCHEMA = "search_event_id int, id bigint, fts_score double, semantic_score double, author_score double, recency_score double, rank string"


def brute(rows):
    best = {}
    for s, i, *scores, _ in rows:
        if s is None or i is None:
            continue
        own = [None if x is None or x != x else x for x in scores]
        old = best.get((s, i), [None] * 4)
        best[s, i] = [max((y for y in (a, b) if y is not None), default=None) for a, b in zip(old, own)]
    out = {}
    for s in {k[0] for k in best}:
        items = {i: v for (t, i), v in best.items() if t == s}
        vectors = {}
        for i, v in items.items():
            p = []
            for c in range(4):
                column = [w[c] for w in items.values() if w[c] is not None]
                p.append(0.0 if v[c] is None else (sum(x < v[c] for x in column) + (sum(x == v[c] for x in column) + 1) / 2) / len(items))
            vectors[i] = sorted(p)
        order = sorted(items, key=lambda i: ([-x for x in vectors[i]], i))
        out |= {(s, i): n for n, i in enumerate(order, 1)}
    return out


def run(spark, rows):
    return {(r.search_event_id, r.id): r["rank"] for r in leximin(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_against_brute_force(spark):
    r = random.Random(5)
    value = lambda: r.choice([None, float("nan"), 0.0, 1.0, r.random(), r.random() * 1e6, -r.random()])
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, r.randrange(200)]), value(), value(), value(), value(), "x") for _ in range(500)]
    assert run(spark, rows) == brute(rows)
    plain = leximin(spark.createDataFrame(rows, SCHEMA), support=False)
    assert plain.columns == ["search_event_id", "id", "rank"] and {(r.search_event_id, r.id): r["rank"] for r in plain.collect()} == brute(rows)


def test_a_strong_score_masks_no_weak_one(spark):
    rows = [(1, 1, 1e9, 0.1, 0.1, 0.1, ""), (1, 2, 2.0, 0.2, 0.2, 0.2, ""), (1, 3, 1.0, 0.3, None, 0.3, "")]
    assert [i for (_, i), n in sorted(run(spark, rows).items(), key=lambda x: x[1])] == [2, 1, 3]


def test_ties_and_empty(spark):
    assert run(spark, [(1, 9, *[1.0] * 4, ""), (1, 4, *[1.0] * 4, "")]) == {(1, 4): 1, (1, 9): 2}
    assert run(spark, []) == {} and len(SCORES) == 4
