"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints at ``max_bits`` = 4 or fewer differing bits are cut into 3 segments (22, 21 and 21 bits), so that of two
linked fingerprints one segment differs by at most one bit. Each segment is indexed by its variants with one bit left
out; two segments that differ by at most one bit share a variant, found by an equality join, and the whole fingerprints
are then compared. Equal fingerprints are one row from the start, so copies never meet in pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, begin_work, quoted, unused
from .components import connected_components

#: Ids of rows to drop are broadcast up to this many (8 bytes each), so that texts need not move.
MAX_BROADCAST_IDS = 1_000_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42


#: Odd numbers that turn a shingle's hash into independent ones for further sketches.
TURNS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's ``words``-word shingles in order, A-Z lower-cased, a very long text in parts."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z alone
    if not found:
        return
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words, len(found)) - 1 :][:n] - 1).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        yield np.array([digest(view[a:z], SEED) for a, z in zip(starts[at : at + 65536], stops[at : at + 65536])], np.uint64)


def sketch(text: str | None, words: int = 4, count: int = 1) -> list[int]:
    """``count`` unsigned 64-bit SimHashes of the text's shingles, the first of their XXH64, the others of turns of it.

    Fewer words than a shingle has: the whole sequence is the one shingle. NULL, empty and blank texts: zeros.
    """
    ones, n = np.zeros((count, 64), np.int64), 0
    for h in shingle_hashes(text, words):
        n += len(h)
        for k in range(count):
            x = h
            if k:
                x = (x ^ (x >> np.uint64(31))) * np.uint64(TURNS[k - 1])
                x = (x ^ (x >> np.uint64(29))) * np.uint64(TURNS[0])
                x = x ^ (x >> np.uint64(32))
            ones[k] += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * row > n).tobytes(), "big") for row in ones] if n else [0] * count


def fingerprint(text: str | None, words: int = 4) -> int:
    return sketch(text, words)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, count: int = 1) -> DataFrame:
    """(doc_id, h, fp, and fp2 ... for more sketches): a row for each row of ``docs``, 64-bit numbers as signed ones; h: a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("simhash")
        for batch in batches:
            made = np.array([sketch(t.as_py(), words, count) for t in batch.column(2)], np.uint64).reshape(-1, count)
            cols = [pa.array(np.ascontiguousarray(made[:, k]).view(np.int64)) for k in range(count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)

    names = ["doc_id", "h", *(_sketch_name(k) for k in range(count))]
    return _thin(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _sketch_name(k: int) -> str:
    return f"fp{k + 1}" if k else "fp"


def _thin(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("h"), quoted(text_col).alias("text"))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of so few segments that one of them differs by at most one bit."""
    n = max_bits // 2 + 1
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def linked_fingerprints(distinct: DataFrame, max_bits: int = 4, count: int = 1, parts: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints ``fp`` at 1 to ``max_bits`` differing bits; each pair once.

    With ``count`` sketches (``fp``, ``fp2`` ...) bits are counted over all of them, and ``parts`` gives the number of
    segments of each: then those pairs are found that have a segment with at most one differing bit.
    """
    segments = [(k, low, width) for k in range(count) for low, width in _segments(max_bits if parts is None else 2 * parts - 1)]
    names = [_sketch_name(k) for k in range(count)]
    key: list[Column] = []
    for k, low, width in segments:
        seg = F.shiftrightunsigned(names[k], low).bitwiseAND((1 << width) - 1)
        # the variant number and the segment without one bit: two texts share it if they agree but for that bit
        key += [seg.bitwiseAND(((1 << width) - 1) & ~(1 << bit)) * 1024 + (64 * k + low + bit) for bit in range(width)]
    index = distinct.select(*names, F.explode(F.array(*key)).alias("k"))
    # both sides have the same column names, so that the planner deals the index out once for the two; merged, as
    # the planner takes the index to be as small as the fingerprints and might broadcast it
    diff = [F.col(f"a.{n}").bitwiseXOR(F.col(f"b.{n}")) for n in names]
    bit = F.col("a.k").bitwiseAND(1023)

    def part(s: int) -> Column:
        k, low, width = segments[s]
        return diff[k].bitwiseAND(F.lit(_signed(((1 << width) - 1) << low)))

    # of all variants that a pair shares, it is taken at the first: the first segment with at most one differing bit,
    # and there the differing bit, or the lowest when the segments are equal
    first = F.lit(False)
    for s in reversed(range(len(segments))):
        k, low, width = segments[s]
        single = F.bit_count(part(s)) <= 1
        inside = (bit >= 64 * k + low) & (bit < 64 * k + low + width)
        exact = F.when(part(s) == 0, bit == 64 * k + low).otherwise(F.bit_count(part(s).bitwiseAND(_bit_mask(bit - 64 * k))) == 1)
        first = F.when(single, inside & exact).otherwise(first)
    bits = sum((F.bit_count(d) for d in diff[1:]), F.bit_count(diff[0]))
    close = (F.col("a.fp") < F.col("b.fp")) & (bits <= max_bits) & first
    return index.alias("a").join(index.alias("b").hint("merge"), (F.col("a.k") == F.col("b.k")) & close).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bit_mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, words: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, ``fingerprint`` (16 hex digits), ``component_id`` (least doc_id reachable over links).

    Two documents are linked when their fingerprints differ in ``max_bits`` bits or fewer; texts without words have
    fingerprint zero and are linked like any other. Repeated rows and ids stay, a row each. A row with a NULL id links
    like any other; its component is the least id that is not NULL, or NULL if there is none. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprints(docs, id_col, text_col, words), "fps")
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = scratch.put(linked_fingerprints(distinct, max_bits), "links")
    # nodes are fingerprints; a component's id is the least document id of its fingerprints
    joined = connected_components(links, scratch).withColumnRenamed("node", "fp")
    named = scratch.put(distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    ids = scratch.put(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    table = scratch.put(named.select("fp", "component").join(ids, "component").select("fp", "component_id"), "table")
    out = fps.join(table, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(fp, s) of ``texts`` (fp, text): the hashes of the text's different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("simhash")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(np.concatenate([*shingle_hashes(t.as_py(), words), np.zeros(0, np.uint64)])).view(np.int64) for t in batch.column(1).slice(at, 256)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), lists], ["fp", "s"])

    return texts.mapInArrow(run, "fp bigint, s array<bigint>")


def similar(pairs: DataFrame, tops: DataFrame, thin: DataFrame, words: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' sets of shingles have a Jaccard similarity of ``similarity`` or more.

    ``tops``: for each fingerprint ``fp`` the row (``top``) whose text stands for it; ``thin``: all rows.
    """
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    ends = scratch.put(ends.join(tops, ends["end"] == tops["fp"]).select("fp", F.col("top.doc_id").alias("i"), F.col("top.h").alias("t")), f"{name}-ends")
    few = ends.count() <= MAX_BROADCAST_IDS
    texts = thin.join(F.broadcast(ends) if few else ends, (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("fp", "text")
    sets = scratch.put(shingle_sets(texts, words).dropDuplicates(["fp"]), f"{name}-sets")
    both = pairs.join(sets.select(F.col("fp").alias("fa"), F.col("s").alias("sa")), F.col("a") == F.col("fa"))
    both = both.join(sets.select(F.col("fp").alias("fb"), F.col("s").alias("sb")), F.col("b") == F.col("fb"))
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("all"))
    out = scratch.put(shared.filter(F.col("n") >= similarity * (F.col("all") - F.col("n"))).select("a", "b"), f"{name}-alike")
    scratch.drop(f"{name}-ends", f"{name}-sets")
    return out


#: ``keep_one`` compares two sketches of 64 bits; pairs at more differing bits than this of the 128 are not verified. At a
#: similarity of 0.8 about 19.5 bits differ (standard deviation 4), in unlike texts 64 (5.7).
SKETCHES, SKETCH_BITS = 2, 26
#: Segments of 16 bits in each sketch. At a similarity of 0.8, 28 % have at most one differing bit, so one of 8 has in 92 %.
SEGMENTS = 4


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the least id (NULL last), then the least hash of the text.

    Two texts are near-duplicates when the sets of their ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Candidates are found by SimHash: first those at ``max_bits`` differing bits of the first
    sketch, whose verified groups give one text each; those texts' pairs that have in one of the segments of two
    sketches at most one differing bit; all are verified on the shingles themselves. Exact copies, and texts of equal
    fingerprints, are one from the start. Recall falls below 1 towards the least similarity (see README).

    All columns are kept as they are, whatever their names. Texts without words are one group; rows that share an id are
    told apart by their texts, and of rows equal in both one stays. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    thin = _thin(docs, id_col, text_col)
    rows = scratch.put(fingerprints(docs, id_col, text_col, words, SKETCHES), "rows")
    top = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("top")
    distinct = scratch.put(rows.groupBy("fp").agg(top, F.min("fp2").alias("fp2")), "distinct")
    links = similar(scratch.put(linked_fingerprints(distinct, max_bits), "links"), distinct, thin, words, similarity, scratch, "near")
    near = connected_components(links, scratch, "near-groups")
    named = scratch.put(distinct.join(near, F.col("fp") == F.col("node"), "left").select("fp", "fp2", "top", F.coalesce("component", "fp").alias("first")), "named")
    ones = named.filter("fp = first").select("fp", "fp2", "top")
    pairs = scratch.put(linked_fingerprints(ones, SKETCH_BITS, SKETCHES, SEGMENTS), "pairs")
    wide = connected_components(similar(pairs, ones, thin, words, similarity, scratch, "wide"), scratch, "wide-groups")
    groups = scratch.put(named.join(wide, F.col("first") == F.col("node"), "left").select("fp", "top", F.coalesce("component", "first").alias("group")), "groups")
    heads = scratch.put(groups.groupBy(F.col("group").alias("g")).agg(F.min("top").alias("head")), "heads")
    stays = groups.join(heads, F.col("group") == F.col("g")).select(F.col("fp").alias("f"), F.col("head.doc_id").alias("head_id"), F.col("head.h").alias("head_h"))
    gone = rows.join(stays, F.col("fp") == F.col("f")).filter(~(F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))))
    own_id, own_hash, gone_id, gone_hash, number = unused(docs, "id", "hash", "gone_id", "gone_hash", "number")
    gone = scratch.put(gone.select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_hash)).distinct(), "gone")
    few = gone.count() <= MAX_BROADCAST_IDS
    kept = docs.withColumn(own_id, quoted(id_col).cast("long")).withColumn(own_hash, F.xxhash64(quoted(text_col)))
    kept = kept.join(F.broadcast(gone) if few else gone, (F.col(own_hash) == F.col(gone_hash)) & F.col(own_id).eqNullSafe(F.col(gone_id)), "left_anti")
    twice = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_hash))
    twice = scratch.put(twice, "twice")
    if twice.limit(1).count():  # repeated rows
        same = (F.col(own_hash) == F.col(gone_hash)) & F.col(own_id).eqNullSafe(F.col(gone_id))
        first = Window.partitionBy(own_id, own_hash).orderBy(*(quoted(c) for c in docs.columns))
        many = kept.join(twice, same, "left_semi").withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1).drop(number)
        kept = kept.join(twice, same, "left_anti").unionByName(many)
    return kept.select(*(quoted(c) for c in docs.columns))
