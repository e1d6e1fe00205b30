import hashlib
import random
import re

import pyarrow as pa

from rowsmith.llm import substring_dedup as S
from rowsmith.llm.queries import op9_substring_dedup

from .helpers import SMALL, docs, odd_rows


def plain(rows):
    """rows in order; windows as tuples of words."""
    seen, out = set(), []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(plain(rows), key=str)


def test_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    same(op9_substring_dedup(spark, SMALL), rows)


def mixed_rows():
    """Passages that overlap, repeat within a document, meet at different neighbours and differ by one word."""
    rng = random.Random(3)
    pool = [[f"w{rng.randrange(300)}" for _ in range(rng.choice((19, 20, 21, 27, 40, 60)))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 6))]
            p = list(rng.choice(pool))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            a = rng.randrange(0, 5)
            words += p[a:]
        rows.append((i, "".join(w + rng.choice((" ", "  ", "\n", "\t")) for w in words)))
    rows += [(60, "tick " * 130), (61, "tick tock " * 40), (62, rows[5][1]), (63, "tick " * 50)]
    return rows


def test_passages_in_any_number_of_batches(spark):
    rows = mixed_rows()
    for batches in (1, 2, 7):
        same(S.dedup_digest(docs(spark, rows), batches=batches), rows)


def test_odd_rows(spark):
    rows = sorted(((r[0], r[1]) for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    same(S.dedup_digest(docs(spark, rows)), rows)
    assert S.dedup_digest(docs(spark, [])).count() == 0
    texts = {r.doc_id: r.text for r in S.remove_repeats(docs(spark, [(1, None), (2, "a  b"), (3, "x " * 30)])).collect()}
    assert texts == {1: None, 2: "a b", 3: "x"}


def test_words_are_joined_as_they_are_cut():
    rng = random.Random(6)
    for k in range(3000):
        text = "".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85\u00a0\u2003a\u00e9z") for _ in range(rng.randrange(0, 40)))
        assert S.joined_words(text.encode()) == b" ".join(S.words_of(text)) == " ".join(re.findall(r"[^\x20\x09-\x0D]+", text)).encode(), k


def test_no_text_is_cut_into_words_unless_some_of_them_go(monkeypatch):
    texts, cut = ["some  words\nthat stay ", None, "", "a b c " * 20], []
    span = pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())]))
    spans = pa.array([None, None, [], [{"lo": 30, "n": 1}, {"lo": 3, "n": 2}, {"lo": 4, "n": 1}]], span)
    whole = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts), spans], ["doc_id", "text", "spans"])
    kept = S.kept_words
    monkeypatch.setattr(S, "words_of", lambda t: cut.append(t))
    monkeypatch.setattr(S, "kept_words", lambda w, s: cut.append(len(w)) or kept(w, s))
    want = []
    for i, t, gone in zip(range(4), texts, ((), (), (), {*range(3, 24), *range(30, 50)}), strict=True):
        words = (t or "").split()
        left = [w for k, w in enumerate(words) if k not in gone]
        want.append((i, len(words), len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    for first in (0, 1, 3):  # slices of a batch too
        cut.clear()
        got = [tuple(r.values()) for b in S._keep(iter([whole.slice(first)])) for r in b.to_pylist()]
        assert got == want[first:] and cut == [60]
