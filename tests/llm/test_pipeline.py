import random
import re
from collections import Counter

import corpus_pipeline as P
from rowsmith.llm import simhash
from rowsmith.llm.language_id import identify

from .helpers import SMALL, docs, odd_rows
from .test_decontaminate import plain as contaminated
from .test_mixing import inverse, unit
from .test_token_records import plain as tokens


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def shingles(text):
    words = re.findall("[^\\x20\\x09-\\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept_of(rows):
    """One id of each group of texts whose shingles are alike to 0.8 or more."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a == sets[j] or n >= 0.8 * (len(a) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({min(rows[j][0] for j in range(len(rows)) if find(j) == r) for r in {find(i) for i in range(len(rows))}})


def test_near_copies_are_found_to_their_similarity(spark):
    rng, rows, groups = random.Random(6), [], 60
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    found = {}
    for share in (0.005, 0.01, 0.02):  # each word changes so often; five shingles change with it
        rows, near = [], []
        for g in range(groups):
            text = [word() for _ in range(rng.randrange(120, 400))]
            other = [word() if rng.random() < share else w for w in text]
            a, b = shingles(" ".join(text)), shingles(" ".join(other))
            near.append(a != b and len(a & b) >= 0.8 * len(a | b))
            rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(other))]
        kept = {r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()}
        assert all(2 * g in kept for g in range(groups))
        found[share] = (sum(near), sum(n and 2 * g + 1 not in kept for g, n in enumerate(near)))
        assert not any(2 * g + 1 not in kept for g, n in enumerate(near) if not n and rows[2 * g][1] != rows[2 * g + 1][1])
    print("pairs and found by share of words changed:", found)
    assert all(f >= least * n for (n, f), least in zip(found.values(), (0.95, 0.85, 0.6), strict=True)), found


def test_every_stage_against_its_plain_form(spark):
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    cols = docs_.columns
    preds = {r.doc_id: (r.lang_pred, r.ambiguous) for r in identify(docs_).collect()}
    one = P.identify_languages(spark, docs_, SMALL)
    assert one.columns == cols
    assert {r.doc_id for r in one.collect()} == {i for i, (p, a) in preds.items() if p != "und" and not a}
    have = [(r.doc_id, r.text) for r in one.collect()]
    two = P.drop_near_duplicates(spark, one, SMALL)
    kept, plain = {r.doc_id for r in two.collect()}, set(kept_of(have))
    assert two.columns == cols and plain <= kept and len(kept - plain) <= 0.01 * len(plain)  # near the least similarity a pair may be missed
    have = [(r.doc_id, r.text) for r in two.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    three = P.drop_benchmark(spark, two, SMALL)
    bad = contaminated(have, items)
    assert bad and three.columns == cols and {r.doc_id for r in three.collect()} == {i for i, _ in have} - set(bad)
    kept = three.collect()
    four = P.mix_sources(spark, three, SMALL)
    held = Counter(r.source for r in kept)
    share = len(kept) / sum(n**0.5 for n in held.values())
    want = {r.doc_id: inverse(unit("mix", r.doc_id), held[r.source] ** 0.5 / held[r.source] * share) for r in kept}
    assert four.columns == cols and Counter(r.doc_id for r in four.collect()) == Counter({i: n for i, n in want.items() if n})
    have = sorted((r.doc_id, r.text) for r in four.collect())
    five = P.write_tokens(spark, four, SMALL)
    assert sorted(map(tuple, five.collect())) == sorted(tokens(have))
    assert sorted(map(tuple, P.run(spark, SMALL).collect())) == sorted(tokens(have))


def test_odd_rows_go_through_all_stages(spark):
    texts = [(100 + i, "the words of the one and the other text that is here", "en", "a") for i in range(12)]
    texts += [(200 + i, "die worte und der satz mit dem anderen wort darin", "de", "b") for i in range(12)]
    clash = ["copies_of", "score", "lang_pred", "ambiguous", "__text", "_id", "_drop", "_bad", "_key", "copies", "copy", "hash", "gone_id", "a.b", "c`d", "number", "h", "fp"]
    df = docs(spark, texts + odd_rows()).crossJoin(spark.createDataFrame([tuple(range(777, 777 + len(clash)))], ", ".join(f"`{c.replace('`', '``')}` int" for c in clash)))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns, name
        assert all(tuple(r)[5:] == tuple(range(777, 777 + len(clash))) for r in out.collect()), name
        df = spark.createDataFrame(out.collect(), out.schema)
    assert P.write_tokens(spark, df, SMALL).count() == df.count()
    empty = docs(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
