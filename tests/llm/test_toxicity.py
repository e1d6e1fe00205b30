import math
import random

from rowsmith.llm import toxicity as T
from rowsmith.llm.queries import op1_toxicity

from .helpers import SMALL, crc, docs, odd_rows

BAD = ["grumbletoad", "snarkfang"]


def corpus(n=900):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        words = [f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(rng.randrange(20, 120))]
        y = int(i % 5 == 0)
        for _ in range(rng.randrange(1, 4) * y):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, y))
    return rows, labels


def test_held_out_texts(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in T.toxicity(docs(spark, rows), lab).collect()}
    truth = dict(labels)
    assert len(out) == len(rows)
    for i, r in out.items():
        assert r.held_out == (crc(str(i)) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(truth[i], r.predicted) for i, r in out.items() if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    # a label that is held out has no part in any score
    flipped = spark.createDataFrame([(i, 1 - y if crc(str(i)) % 3 == 1 else y) for i, y in labels], "doc_id bigint, toxic int")
    assert {r.doc_id: r.score for r in T.toxicity(docs(spark, rows), flipped).collect()} == {i: r.score for i, r in out.items()}


def test_odd_rows(spark):
    rows, labels = corpus(200)
    odd = [((i + 1000) if i is not None else None, *r) for i, *r in odd_rows()]
    lab = spark.createDataFrame([*labels, (1001, 1), (1001, None), (None, 1), (1003, 7)], "doc_id bigint, toxic int")
    out = T.toxicity(docs(spark, [*rows, *odd]), lab).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert len({r.score for r in T.toxicity(docs(spark, odd), none).collect()}) == 1
    assert T.toxicity(docs(spark, []), lab).count() == 0


def test_likelihoods_by_hand():
    single, pair = T.likelihoods({"a": (10, 10), "b": (8, 0)}, {("a", "b"): (4, 0), ("a", "a"): (2, 3), ("b", "a"): (5, 0)}, {"a": 300, "b": 40}, 1000)
    mass = 0.75 * 2 * 2 / 28
    p = [(1 - mass) * 7.25 / 16.5 + mass * 0.04, mass * 0.04]
    assert math.isclose(single["b"], math.log(p[0] / p[1]))
    m = 0.75 * 2 * 2 / 9
    assert math.isclose(pair["a b"], math.log(((1 - m) * 3.25 / 4.5 + m * p[0]) / (m * p[1])))
    assert "b a" not in pair  # only one class has words after b: both back off
    assert T.features([], single, pair) == (0.0, 0.0)
    assert T.features(["unknown"] * 9, single, pair) == (0.0, 0.0)
    # the more often all documents have a word, the less a few occurrences in one class tell
    rare, common = (T.likelihoods({"a": (10, 10), "b": (8, 0)}, {}, {"a": 300, "b": n}, 1000)[0]["b"] for n in (9, 900))
    assert rare > common > 0


def test_shared_counts_over_all_texts(spark, monkeypatch):
    rows = [(i, t, *x) for i, t, *x in odd_rows()] + [(50, "One two. one TWO three", None, None), (None, "zwei two three_four " * 40, "de", "c")]
    want = {}
    for _, t, *_ in rows:
        for w in set(T.words_of(t)):
            want[w] = want.get(w, 0) + 1
    got = lambda: {r.w: r.n for r in T.shared_counts(docs(spark, rows)).collect()}
    assert got() == want and want["two"] == 5 and want["long"] == 1
    monkeypatch.setattr(T, "HELD_WORDS", 7)  # handed on in parts
    assert got() == want
    assert T.shared_counts(docs(spark, [])).count() == 0


def test_whole_table(spark):
    out = op1_toxicity(spark, SMALL).collect()
    assert len({r.doc_id for r in out}) == len(out) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
