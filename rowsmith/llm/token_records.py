"""Token ids as length-delimited binary records, with a separate offset index.

A record file is a run of frames, one per document, in ascending id order. Integers are little-endian:

    length      u64   bytes of the payload
    check       u32   masked crc32 of the 8 length bytes
    payload           flags u8 (bit 0: the id is not NULL, bit 1: ids take 4 bytes, else 2), id i64, ids
    check       u32   masked crc32 of the payload

A crc c is masked as ((c >> 15) | (c << 17)) + 0xA282EAD8 mod 2^32, so that the check of bytes that hold checks is not
degenerate. The index is a Parquet table with a row for each record (file, record, offset, length, ids before it in its
file), written apart from the data so that readers can shuffle records without a scan.

Files are written to a temporary name and moved into place, so a task that runs again after an executor was lost
replaces its own file. They go through ``pyarrow.fs``, to any file system that it knows.
"""

from __future__ import annotations

import posixpath
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, begin_work, on_other_work

INDEX_SCHEMA = "doc_id bigint, file int, record bigint, offset bigint, length bigint, first bigint, n_tokens bigint"
#: Words longer than this are encoded without being remembered.
LONGEST_KEPT = 48
MAX_BROADCAST_FILES = 100_000
CUT = re.compile(r"(?<=\S)(?= )")
WHITE = r"[\pZ\s\x0b\x1c-\x1f\x85]"
#: A space with white space before it, and white space or the end after it: a cut before it would tear white space apart.
ODD = rf"{WHITE} (?:{WHITE}|\z)"
CUT_MARK = "\x01"
#: Bytes of text that are encoded at a time, and one text more: many times as much memory is taken meanwhile.
ENCODE_CHARS = 2_000_000
#: Letters below this and these marks are told apart alike by Python and by the pre-tokenizer's pattern.
LATIN_END, MARKS = "\u0250", frozenset(".,;:!?")


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


#: Characters of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(b) if b in _PLAIN else chr(256 + sum(c not in _PLAIN for c in range(b))) for b in range(256)}


def strings(pieces: pa.Array) -> list[str]:
    """The same as ``to_pylist`` for an array without NULL whose strings don't hold ``CUT_MARK``: Python cuts one long string
    much faster than Arrow makes a scalar of each value."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(whole, CUT_MARK)[0].as_py().split(CUT_MARK) if len(pieces) else []


class WordEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, remembering the ids of words.

    Its pre-tokenizer leaves the last of several white spaces to the word after it, so a text cut before its spaces gives
    the same ids piece by piece, but where white space stands on both sides of a space. Arrow cuts the texts of a batch
    and numbers their different pieces; a piece not seen before is cut by the pre-tokenizer's pattern, and what is new of
    that goes to the library's BPE model. Texts that hold the string of an added token (the end of a text, say) go to the
    library as a whole, which gives them that token's id. At most ``remember`` pieces and parts are kept, in two
    generations, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str, remember: int = 450_000):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        kind = json.loads(self.tok.to_str())
        before = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.tokenize = self.tok.model.tokenize  # knows no added tokens
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.parts = regex.compile(public_tokenizers.PATTERN).findall
        self.half = remember // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        body = piece[1:] if piece[0] == " " else piece
        # a word of Latin letters is one part, and a mark after it another: the common cases, told without the pattern
        if not (body.isalpha() and max(body) < LATIN_END):
            if body[-1:] in MARKS and (head := body[:-1]).isalpha() and max(head) < LATIN_END:
                return self._known(piece[:-1]) + self._known(body[-1])
            parts = self.parts(piece)
            if len(parts) > 1:  # a part is a piece too, and often known as one
                return b"".join([self._known(p) for p in parts])
        if piece.isascii() and body.isalpha():  # these letters stand for themselves
            chars = BYTE_CHARS[32] + body if piece[0] == " " else piece
        else:
            chars = piece.encode("utf-8", "replace").decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.tokenize(chars)]).tobytes()

    def _known(self, piece: str) -> bytes:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = self._piece(piece) if piece else b""
            if len(piece) <= LONGEST_KEPT:
                self.young[piece] = ids
                if len(self.young) > self.half:
                    self.old, self.young = self.young, {}
        return ids

    def _all_known(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.young.get, pieces))  # most are there: no call of our own for these
        return [self._known(p) if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (NULL: empty) as little-endian u32 bytes."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        apart = pc.match_substring_regex(texts, ODD)
        for a in [CUT_MARK, *self.added]:
            apart = pc.or_(apart, pc.match_substring(texts, a))
        out: list[bytes] = [b""] * len(texts)
        apart = apart.to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(apart).tolist():
            t = texts[k].as_py()
            if any(a in t for a in self.added):
                out[k] = array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes()
            else:
                out[k] = b"".join(map(self._known, CUT.split(t)))
        rows = np.flatnonzero(~apart)
        if not len(rows):
            return out
        pieces = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rows)), " ", CUT_MARK + " "), CUT_MARK)
        coded = pieces.flatten().dictionary_encode()
        ids = self._all_known(strings(coded.dictionary))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        # token j of all texts is token j - ends of its piece, from where the piece's ids start
        tokens = flat[np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        bounds = 4 * ends[np.concatenate(([0], np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False))))]
        for k, lo, hi in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[k] = tokens[lo:hi]
        return out


_ENCODERS: dict[str, WordEncoder] = {}
on_other_work("token_records", _ENCODERS.clear)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder: kept from task to task of this operator, and let go when the worker turns to another one."""
    begin_work("token_records")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def frame(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids
    payload = struct.pack("<Bq", (doc_id is not None) | (not narrow) << 1, doc_id or 0) + body
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def read_frames(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids as u32) of each record; raises ValueError where a length or payload does not match its check."""
    while head := stream.read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record length")
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked_crc(body[:n]) != struct.unpack("<I", body[n:])[0]:
            raise ValueError("damaged record")
        flags, doc_id = struct.unpack_from("<Bq", body)
        ids = np.frombuffer(body[9:n], "<u4" if flags & 2 else "<u2").astype("<u4")
        yield (doc_id if flags & 1 else None), ids


def file_name(part: int) -> str:
    return f"part-{part:06d}.records"


def _writer(path: str, end_id: int, tokenizer: str, narrow: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        ctx, enc, end = TaskContext.get(), encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = ctx.partitionId()
        store.create_dir(base, recursive=True)
        final, tmp = posixpath.join(base, file_name(part)), posixpath.join(base, f"_{part}-{ctx.taskAttemptId()}.tmp")
        rows, out, offset, record, first = [], None, 0, 0, 0
        for batch in batches:
            ids_col, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths, at = pc.binary_length(texts).to_pylist(), 0
            while at < len(ids_col):  # some MB of text at a time
                end_at, size = at, 0
                while end_at < len(ids_col) and size < ENCODE_CHARS:
                    size += lengths[end_at] or 0
                    end_at += 1
                for doc_id, ids in zip(ids_col[at:end_at], enc.encode(texts.slice(at, end_at - at)), strict=True):
                    out = out or store.open_output_stream(tmp)
                    data = frame(doc_id, ids + end, narrow)
                    out.write(data)
                    n = len(ids) // 4 + 1
                    rows.append((doc_id, part, record, offset, len(data), first, n))
                    offset, record, first = offset + len(data), record + 1, first + n
                at = end_at
                if len(rows) >= 10_000:
                    yield _index_batch(rows)
                    rows = []
            pa.default_memory_pool().release_unused()
        if out:
            out.close()
            store.move(tmp, final)
        if rows:
            yield _index_batch(rows)

    return write


INDEX_ARROW = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), *((c, pa.int64()) for c in ("record", "offset", "length", "first", "n_tokens"))])


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), INDEX_ARROW, strict=True)], schema=INDEX_ARROW)


def write_records(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 65536) -> DataFrame:
    """Write every document's ids, with ``end_id`` appended, to record files under ``path``/data and the index to ``path``/index.

    Files ascend by document id, and so do records in a file. A NULL or empty text gives the end id alone. Rows that
    share an id are each written, in the order of their texts; NULL ids come first. An empty table writes no records
    and an empty index. Ids take two bytes when ``vocabulary`` (one more than the largest id, ``end_id`` included) fits.
    Returns the index as read back, with ``start``, the ids of all documents before the record.
    """
    spark = docs.sparkSession
    narrow = vocabulary <= 65536 and end_id < 65536
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a text decides only between rows of one id, so that one id held by many rows is still split into ranges
    ordered = thin.repartitionByRange("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "text")
    index = ordered.mapInArrow(_writer(f"{path}/data", end_id, tokenizer, narrow), INDEX_SCHEMA)
    index.write.mode("overwrite").parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, with ``start``: ids of all documents before the record, over all files."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("_n"))  # a row for each file
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return index.join(_few(files), "file").withColumn("start", F.col("_before") + F.col("first")).drop("_before")


def _few(files: DataFrame) -> DataFrame:
    """A row for each file: broadcast up to MAX_BROADCAST_FILES of them (16 bytes each)."""
    return F.broadcast(files) if files.count() <= MAX_BROADCAST_FILES else files


DIGEST_SCHEMA = "file int, record bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, first bigint"
DIGEST_ARROW = pa.schema([("file", pa.int32()), *((c, pa.int64()) for c in ("record", "doc_id", "n_tokens", "ids_crc32", "first"))])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read all record files again and check every frame: file, record, doc_id, n_tokens, ids_crc32 (of the ids as little-endian u32), start."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("_n"), F.count(F.lit(1)).alias("_records"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(f"{path}/data")
        for batch in batches:
            for part, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, first, k = [], 0, 0
                with store.open_input_stream(posixpath.join(base, file_name(part)), buffer_size=1 << 20) as stream:
                    for k, (doc_id, ids) in enumerate(read_frames(stream)):
                        rows.append((part, k, doc_id, len(ids), zlib.crc32(ids.tobytes()), first))
                        first += len(ids)
                        if len(rows) >= 10_000:
                            yield _digest_batch(rows)
                            rows = []
                if rows:
                    yield _digest_batch(rows)
                if k + 1 != records:
                    raise ValueError(f"{file_name(part)} holds {k + 1} records, the index {records}")

    # one row a file, so few that the planner would put them all into one task: their number of tasks is given
    tasks = max(1, min(files.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    digests = files.select("file", "_records").repartitionByRange(tasks, "file").mapInArrow(scan, DIGEST_SCHEMA)
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return digests.join(_few(starts), "file").withColumn("start", F.col("_before") + F.col("first")).drop("_before", "first")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGEST_ARROW, strict=True)], schema=DIGEST_ARROW)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write records to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "records")
    write_records(docs, tokenizer, end_id, scratch.base)
    return read_records(docs.sparkSession, scratch.base).select("doc_id", "start", "n_tokens", "ids_crc32")
