import re

import xxhash

from rowsmith.llm.queries import op4_simhash
from rowsmith.llm.simhash import fingerprint, linked_fingerprints, near_duplicates

from .helpers import SMALL, docs, odd_rows


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids_fps):
    parent = list(range(len(ids_fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, f) in enumerate(ids_fps):
        for j in range(i):
            if (f ^ ids_fps[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(ids_fps):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(ids_fps)]


def order(rows):
    return sorted(rows, key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert order(map(tuple, op4_simhash(spark, SMALL).collect())) == order(components(rows))


def test_odd_rows(spark):
    rows = [*odd_rows(), (7, "ÀB one"), (8, "three words only")]
    want = components([(r[0], plain(r[1])) for r in rows])
    assert order(map(tuple, near_duplicates(docs(spark, rows)).collect())) == order(want)
    assert near_duplicates(docs(spark, [])).count() == 0


def test_long_text_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(text) == plain(text)


def test_links_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (0, 1, 2, 3, 3, 4, 4, 5)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = sorted(map(tuple, linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()))
    want = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert got == sorted(want)
