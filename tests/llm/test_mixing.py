import hashlib
import math
from collections import Counter

import pytest

from rowsmith.llm.mixing import mix_sources

from .helpers import docs, odd_rows


def inverse(u, rate):
    k, c = 0, math.exp(-rate)
    p = c
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def unit(seed, doc_id):
    key = f"{seed}#{'null' if doc_id is None else doc_id}"
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52


def test_counts_are_the_inverse_of_the_distribution(spark):
    rows = [(i, f"text {i}", "en", ("a", "a", "a", "b")[i % 4]) for i in range(2000)]
    out = mix_sources(docs(spark, rows), {"a": 1, "b": 3}, seed="x").collect()
    rate = {"a": 0.25 * 2000 / 1500, "b": 0.75 * 2000 / 500}
    want = {i: inverse(unit("x", i), rate[s]) for i, _, _, s in rows}
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in want.items() if n})
    assert all(r.copies == want[r.doc_id] and r.copy < r.copies for r in out)
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)


def test_large_rates(spark):
    rows = [(i, "t", "en", "rare" if i == 0 else "big") for i in range(3000)]
    out = mix_sources(docs(spark, rows), {"rare": 1, "big": 0}, seed="y")
    assert out.count() == pytest.approx(3000, rel=0.1)


def test_odd_rows(spark):
    rows = odd_rows()
    out = mix_sources(docs(spark, rows), epochs=3.0)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copies", "copy", "shuffle_key"}
    kept = {r.doc_id for r in out.collect()}
    assert kept <= {r[0] for r in rows}
    assert mix_sources(docs(spark, [])).count() == 0
    assert mix_sources(docs(spark, rows), {None: 1.0}).filter("source is not null").count() == 0
    assert mix_sources(docs(spark, rows), {"no such source": 1.0}).count() == 0
    with pytest.raises(ValueError, match="weights"):
        mix_sources(docs(spark, rows), {"a": -1.0})
