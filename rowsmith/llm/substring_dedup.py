"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` = 20 consecutive words of one document. A word goes if a window that covers it has the same words
as a window that starts earlier: in a document with a smaller id, or earlier in the same document.

Candidates come from hashes, decisions from the words themselves:

1.  Each window has an anchor, the least hash of the ``GRAM``-word grams inside it (the leftmost at a tie). The anchor
    depends on the window's words alone, so equal windows have equal anchors. Consecutive windows with one anchor form a
    block; there are about two blocks for 17 words.
2.  The index keeps, for earlier batches, the anchor hash and place of every block that was new, as immutable runs of
    rows sorted by hash. A batch's anchors are counted and merge-joined with the runs; blocks whose anchor occurs once
    in all are new and are never looked at again.
3.  The texts of the other blocks, old and new, are read: equal blocks are found by a 128-bit digest of their words, and
    of different blocks with one anchor each window is compared by digest. What is not first is removed.
4.  The batch's new blocks become a run. When there are more than ``MAX_RUNS`` runs they are merged into one.

Nothing is paired within a group: each decision is the minimum of a group, found with partial sums, and joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, begin_work, numbered, utf8_slices

WINDOW = 20
GRAM = 5
MAX_RUNS = 4
#: Anchors with different blocks are broadcast up to this many (8 bytes each), and joined by a shuffle beyond.
MAX_BROADCAST_ANCHORS = 1_000_000
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the rolling hashes of bytes in a word and of words in a gram.
BYTE_STEP, WORD_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

BLOCKS = "h bigint, doc bigint, lo int, n int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(step: int, n: int) -> np.ndarray:
    p = np.full(n, step, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_hashes(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and each text's first and last + 1 word (n + 1 numbers)."""
    n = len(blob)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sep = SEPARATOR[blob]
    start = ~sep
    start[1:] &= sep[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    start[heads] = ~sep[heads]
    at = np.flatnonzero(start)
    firsts = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), firsts
    sizes = np.diff(np.append(at, n))
    place = np.arange(at[0], n) - np.repeat(at, sizes)
    power = _powers(BYTE_STEP, int(sizes.max()))
    value = np.where(sep[at[0] :], 0, blob[at[0] :].astype(np.uint64) + np.uint64(1)).astype(np.uint64) * power[place]
    return _mix(np.add.reduceat(value, at - at[0])), firsts


def blocks(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, windows) of every block of all texts, from word hashes."""
    none = np.zeros(0, np.int64)
    grams = len(hashes) - GRAM + 1
    per = WINDOW - GRAM + 1
    if grams < per:
        return none, none, none, none
    g = np.zeros(grams, np.uint64)
    for k, p in enumerate(_powers(WORD_STEP, GRAM)):
        g += hashes[k : k + grams] * p
    g = _mix(g)
    # the least of ``per`` = 16 grams and its place, leftmost at a tie, by doubling
    least, place = g, np.arange(grams)
    width = 1
    while width < per:
        step = min(width, per - width)
        a, b = least[: len(least) - step], least[step:]
        right = b < a
        least, place = np.where(right, b, a), np.where(right, place[step:], place[:-step])
        width += step
    doc = np.repeat(np.arange(len(firsts) - 1), np.maximum(np.diff(firsts) - WINDOW + 1, 0))
    if not len(doc):
        return none, none, none, none
    counts = np.maximum(np.diff(firsts) - WINDOW + 1, 0)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    index = firsts[doc] + window
    anchor = place[index]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], least[index[at]].view(np.int64), window[at], np.diff(np.append(at, len(doc)))


def block_table(docs: DataFrame) -> DataFrame:
    """(h, doc, lo, n) for the blocks of ``docs`` (doc, text): anchor hash, document, first window, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("substring_dedup")
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, blob, offsets in utf8_slices(batch.column(1), 1 << 20):
                doc, h, lo, n = blocks(*word_hashes(blob, offsets))
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[first + doc]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "doc", "lo", "n"])

    return docs.select("doc", "text").mapInArrow(run, BLOCKS)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D, which is where bytes.split() cuts."""
    return (text or "").encode("utf-8", "surrogatepass").split()


BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def joined_words(text: bytes) -> bytes:
    """The words of a text joined by one space, found without an object for each word."""
    flat = text.translate(BLANKS).strip(b" ")
    while b"  " in flat:
        flat = flat.replace(b"  ", b" ")
    return flat


VERIFIED = "h bigint, block binary, doc bigint, lo int, n int, windows array<bigint>"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, spots): the digest of each spot's words and of each of its windows."""
    whole, part = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    for batch in batches:
        texts, lists = batch.column(1).cast(pa.binary()), batch.column(2)
        spots, bounds = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        los, ns = (spots.field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        at = 0
        while at < batch.num_rows:  # some thousand spots at a time
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 20_000, "right")) - 1)
            digests, windows = [], []
            for k in range(at, end):
                flat = joined_words(texts[k].as_py() or b"")
                spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
                stops, starts = [*spaces.tolist(), len(flat)], [0, *(spaces + 1).tolist()]
                lo, n = (x[bounds[k] : bounds[k + 1]].tolist() for x in (los, ns))
                # a copy of some words costs less than a view of them
                for i, c in zip(lo, n):
                    digests.append(whole(flat[starts[i] : stops[i + c + WINDOW - 2]]))
                    windows += [part(flat[a:z]) for a, z in zip(starts[i : i + c], stops[i + WINDOW - 1 : i + c + WINDOW - 1])]
            cut = slice(int(bounds[at]), int(bounds[end]))
            sizes = np.concatenate(([0], np.cumsum(ns[cut]))).astype(np.int32)
            docs = np.repeat(batch.column(0).slice(at, end - at).to_numpy(zero_copy_only=False), np.diff(bounds[at : end + 1]))
            each = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.array(windows, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([spots.field(0)[cut.start : cut.stop], pa.array(digests, pa.binary()), pa.array(docs), pa.array(los[cut]), pa.array(ns[cut]), each], ["h", "block", "doc", "lo", "n", "windows"])
            at = end


class FingerprintIndex:
    """Earlier batches' blocks as sorted runs in a shared folder, and the texts that they point into.

    ``add`` takes batches in ascending order of ids and tells which windows of a batch are not first. Texts of earlier
    batches are given again with each call; they are only read where an anchor was found again.
    """

    def __init__(self, spark: SparkSession, name: str = "fingerprints"):
        self.scratch = Scratch(spark, name)
        self.runs: list[str] = []
        self.made = 0

    def _run(self, df: DataFrame) -> None:
        """Write one immutable run: dealt out and sorted by hash."""
        name = f"run-{self.made}"
        self.made += 1
        # a hash held by very many blocks is spread by document, each part still sorted
        self.scratch.put(df.repartition("h", F.pmod(F.col("doc"), F.lit(16))).sortWithinPartitions("h", "doc", "lo"), name)
        self.runs.append(name)

    def _read(self) -> DataFrame | None:
        tables = [self.scratch.spark.read.schema(BLOCKS).parquet(self.scratch.path(r)) for r in self.runs]
        out = None
        for t in tables:
            out = t if out is None else out.unionByName(t)
        return out

    def compact(self) -> None:
        """Merge all runs into one and delete them."""
        if len(self.runs) > 1:
            old, merged = list(self.runs), self._read()
            self.runs = []
            self._run(merged)
            self.scratch.drop(*old)

    def add(self, batch: DataFrame, corpus: DataFrame, last: bool = False) -> DataFrame:
        """(doc, lo, n): runs of windows of ``batch`` (doc, text) that are not first. ``corpus``: this batch and all before it.

        ``last``: no batch follows, so no run is written.
        """
        put, k = self.scratch.put, self.made
        found, history = block_table(batch), self._read()
        counted = found.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
        if history is None:
            again = counted.filter("c > 1").select("h")
        else:
            old = history.groupBy(F.col("h").alias("old")).agg(F.count(F.lit(1)).alias("o"))
            again = counted.join(old, counted["h"] == old["old"], "left").filter("c > 1 or o is not null").select("h")
        again = put(again, f"again-{k}")
        hit = again.select(F.col("h").alias("again"))
        spots = found.join(hit, found["h"] == hit["again"], "left_semi")
        if history is not None:
            spots = spots.unionByName(history.join(hit, history["h"] == hit["again"], "left_semi"))
        spots = spots.groupBy("doc").agg(F.collect_list(F.struct("h", "lo", "n")).alias("spots"))  # bounded by the document
        spots = put(spots.withColumnRenamed("doc", "at"), f"spots-{k}")
        texts = corpus.join(spots, corpus["doc"] == spots["at"]).select("doc", "text", "spots")
        checked = put(texts.mapInArrow(_verify, VERIFIED), f"checked-{k}")
        # equal blocks: all but the first go as a whole
        place = F.struct("doc", "lo")
        firsts = put(checked.groupBy(F.col("h").alias("fh"), F.col("block").alias("fb")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")), f"firsts-{k}")
        thin = checked.select("h", "block", "doc", "lo", "n")
        labelled = thin.join(firsts, (thin["h"] == firsts["fh"]) & (thin["block"] == firsts["fb"]))
        labelled = put(labelled.select("h", "doc", "lo", "n", (place == F.col("first")).alias("new")), f"labelled-{k}")
        repeated, single = labelled.filter("not new").select("doc", "lo", "n"), labelled.filter("new")
        # different blocks with one anchor: their windows
        many = put(firsts.groupBy(F.col("fh").alias("mh")).agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select("mh"), f"many-{k}")
        few = many.count() <= MAX_BROADCAST_ANCHORS
        mixed = checked.join(F.broadcast(many) if few else many, checked["h"] == many["mh"], "left_semi")
        heads = firsts.select("fh", F.col("first.doc").alias("fd"), F.col("first.lo").alias("fl"))
        mixed = mixed.join(heads, F.expr("h = fh and doc = fd and lo = fl"), "left_semi")
        windows = put(mixed.select("h", "doc", "lo", F.posexplode_outer("windows").alias("k", "w")).select("h", "w", "doc", (F.col("lo") + F.col("k")).alias("lo")), f"windows-{k}")
        first = windows.groupBy(F.col("h").alias("fh"), F.col("w").alias("fw")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
        first = put(first.filter("c > 1"), f"window-firsts-{k}")
        later = windows.join(first, (windows["h"] == first["fh"]) & (windows["w"] == first["fw"])).filter(place != F.col("first"))
        out = put(repeated.unionByName(later.select("doc", "lo", F.lit(1).alias("n"))), f"later-{k}")
        if not last:
            # new: blocks with an anchor of their own, and the first of equal ones
            new = found.join(hit, found["h"] == hit["again"], "left_anti").unionByName(single.select("h", "doc", "lo", "n"))
            if history is not None:
                new = new.join(history.select(F.col("h").alias("oh"), F.col("doc").alias("od"), F.col("lo").alias("ol")), F.expr("h = oh and doc = od and lo = ol"), "left_anti")
            self._run(new)
            if len(self.runs) > MAX_RUNS:
                self.compact()
        self.scratch.drop(*(f"{x}-{k}" for x in ("again", "spots", "checked", "firsts", "labelled", "many", "windows", "window-firsts")))
        return out


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, lists = [], batch.column(2)
        spans, bounds = lists.flatten(), np.cumsum([0, *pc.fill_null(lists.value_lengths(), 0).to_pylist()]).tolist()
        los, ns = (spans.field(k).to_pylist() for k in (0, 1))
        for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True)):
            flat = joined_words(t.as_py() or b"")
            n, removed = flat.count(b" ") + 1 if flat else 0, 0
            lo, hi = bounds[k], bounds[k + 1]
            if lo < hi:
                kept = kept_words(flat.split(), list(zip(los[lo:hi], ns[lo:hi], strict=True)))
                flat, removed = b" ".join(kept), n - len(kept)
            out.append((i, n, removed, hashlib.sha256(flat).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """Words that none of the runs of windows (first window, windows) covers."""
    kept, at = [], 0
    for lo, n in sorted(spans):
        if lo > at:
            kept += words[at:lo]
        at = max(at, lo + n + WINDOW - 1)
    return kept + words[at:]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """The documents (doc, doc_id, text), and (doc, spans) for those with windows that are not first.

    The table is taken in ``batches`` runs of ids, as it would arrive over time; the result does not depend on how
    many. Rows that share an id count as documents one after another in the order of their texts' checksums and texts;
    NULL ids come first of all. NULL, empty and short texts have no window. An empty table gives empty results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    table = numbered(docs, id_col, text_col, scratch)
    cuts = table.select(F.percentile_approx("doc", [(k + 1) / batches for k in range(batches - 1)] or [1.0], 10_000)).first()[0] or []
    cuts = sorted(set(cuts[: batches - 1]))
    index, spans = FingerprintIndex(spark), None
    for k in range(len(cuts) + 1):
        corpus = table.filter(F.col("doc") <= cuts[k]) if k < len(cuts) else table
        batch = corpus.filter(F.col("doc") > cuts[k - 1]) if k else corpus
        found = index.add(batch, corpus, last=k == len(cuts))
        spans = found if spans is None else spans.unionByName(found)
    return table, spans.groupBy(F.col("doc").alias("at")).agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    table, spans = repeated_windows(docs, id_col, text_col, batches)
    return table.join(spans, table["doc"] == spans["at"], "left").select("doc_id", "text", "spans").mapInArrow(_keep, RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """(doc_id, text): every document's kept words, joined by one space; a NULL text stays NULL."""
    table, spans = repeated_windows(docs, id_col, text_col, batches)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept = kept_words(words_of(t), [(x["lo"], x["n"]) for x in s or ()]) if t is not None else None
                texts.append(None if kept is None else b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return table.join(spans, table["doc"] == spans["at"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, text string")
