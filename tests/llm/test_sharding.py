from collections import Counter, defaultdict

from rowsmith.llm.queries import op8_sharding
from rowsmith.llm.sharding import interleave, shard_documents

from .helpers import SMALL, crc, docs, odd_rows


def check(rows, out, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, crc(t)) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(rows, op8_sharding(spark, SMALL).collect(), 8)


def test_odd_rows_and_empty_table(spark):
    rows = odd_rows()
    check(rows, shard_documents(docs(spark, rows), 3).collect(), 3)
    check(rows[:2], shard_documents(docs(spark, rows[:2]), 8).collect(), 8)
    assert shard_documents(docs(spark, []), 8).count() == 0


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "t", "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    out = interleave(docs(spark, rows).drop("n_chars"), 5, bucket_rows=50).collect()
    held = Counter(r[3] for r in rows)
    got = Counter((r.shard, r.source) for r in out)
    for s, n in held.items():
        for k in range(5):
            assert abs(got[k, s] - n / 5) <= 2


def test_seeded_and_independent_of_buckets(spark):
    rows = [(i, "t", "en", f"s{i % 4}") for i in range(500)]
    place = lambda **k: {r.doc_id: (r.shard, r.slot) for r in interleave(docs(spark, rows), 4, **k).collect()}
    assert place(bucket_rows=20) == place(bucket_rows=10_000)
    assert place() != place(seed=18)
