import random
import re
from itertools import combinations

from rowsmith.llm import decontaminate as D
from rowsmith.llm.queries import op3_decontaminate

from .helpers import SMALL, docs, odd_rows


def plain(rows, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bench, out = {i: words(t) for i, t in items}, {}
    for d, t in rows:
        w = words(t)
        for i, b in bench.items():
            best = 0
            for shift in range(-len(b), len(w)):
                same = [0 <= j + shift < len(w) and w[j + shift] == x for j, x in enumerate(b)]
                best = max([best, *(sum(same[s : s + 13]) for s in range(len(b) - 12))])
            if best >= 11:
                out.setdefault(d, {})[i] = max(best, out.get(d, {}).get(i, 0))
    return out


def got(df):
    return {r.doc_id: (list(r["items"]), r.matched) for r in df.collect() if r.contaminated}


def want(found):
    return {d: (sorted(m), max(m.values())) for d, m in found.items()}


def test_masks_see_every_window():
    for bad in combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        assert any(all(k + p not in bad for p, c in enumerate(m) if c == "1") for m in D.MASKS for k in range(D.WINDOW - len(m) + 1))


def test_against_all_alignments(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"t{rng.randrange(50)}" for _ in range(rng.choice((9, 13, 14, 30))))) for i in range(8)]
    rows = []
    for d in range(60):
        w = [f"x{rng.randrange(1000)}" for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            p = items[rng.randrange(8)][1].split()
            a = rng.randrange(0, 4)
            p = p[a : len(p) - rng.randrange(0, 3)]
            for _ in range(rng.randrange(0, 4)):
                p[rng.randrange(len(p))] = "changed"
            w[len(w) // 2 : len(w) // 2] = p
        rows.append((d, ", ".join(w).upper()))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert got(D.flag_documents(docs(spark, rows), bench)) == want(plain(rows, items))
    kept = {r.doc_id for r in D.drop_contaminated(docs(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - set(plain(rows, items))


def test_odd_rows(spark):
    text = " ".join(f"q{i}" for i in range(20))
    items = spark.createDataFrame([(1, text), (2, None), (None, text + " more"), (3, "short one"), (1, "twice " * 14)], "item_id bigint, text string")
    rows = [*odd_rows(), (9, f"before {text} after"), (None, text), (10, "twice " * 20)]
    out = D.flag_documents(docs(spark, rows), items)
    assert out.count() == len(rows)
    bad = {r.doc_id: (r["items"], r.matched) for r in out.collect() if r.contaminated}
    assert bad == {9: ([None, 1], 13), None: ([None, 1], 13), 10: ([1], 13)}
    # the row without an id that holds no item stays
    assert D.drop_contaminated(docs(spark, rows), items).count() == len(rows) - 3
    assert D.flag_documents(docs(spark, []), items).count() == 0
    assert got(D.flag_documents(docs(spark, rows), items.limit(0))) == {}


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    want = got(op3_decontaminate(spark, SMALL))
    monkeypatch.setattr(D, "MAX_BROADCAST_TOKENS", 0)
    monkeypatch.setattr(D, "MAX_BROADCAST_IDS", 0)
    assert want and got(op3_decontaminate(spark, SMALL)) == want
