"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent (single-machine tests) a temporary folder is chosen and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        base = found.rsplit("/", 1)[0] if found else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rowsmith-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Spark's own switch: shuffle files are deleted at the end of the query that they were written for.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written once to the shared folder, so that lost executors cost no recomputation.

    ``put`` writes a DataFrame as Parquet and returns a reader over the files; ``drop`` deletes them. With ``tidy`` what
    was shuffled for a table goes as soon as it is written, else when the driver next collects garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.base = f"{shared_dir(spark)}/rowsmith/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(TIDY) if self.tidy else None
        if before:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            if before:
                self.spark.conf.set(TIDY, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(conf).delete(where, True)


def quoted(name: str) -> Column:
    """The column of this very name, with dots and backticks in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it as long as ``df`` (in any case) or an earlier one has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(docs: DataFrame, work: Callable, text_col: str, keep: list[str], added: list[tuple[str, T.DataType]]) -> DataFrame:
    """``docs`` (its columns ``keep``) through ``work``, which gets Arrow batches of these columns and, last, the text, and
    gives each back with the columns ``added`` in the place of the text. Names are put aside meanwhile, so any will do.

    A text that is kept goes to the worker once, not also as one of the columns, and batches are cut to some MB of text, as
    a batch is held on both sides of the pipe at once."""
    fields = [f for f in docs.schema if f.name in keep and f.name != text_col]
    kept = [f for f in docs.schema if f.name in keep and f.name == text_col]
    plain = docs.select(*(quoted(f.name).alias(f"c{k}") for k, f in enumerate(fields)), quoted(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: deque[pa.Array] = deque()

        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, end in text_runs(batch.column(batch.num_columns - 1)):
                    part = batch.slice(at, end - at)
                    texts.append(part.column(part.num_columns - 1))
                    yield part

        for out in work(parts()):
            text = texts.popleft()
            yield pa.RecordBatch.from_arrays([*out.columns, text], [*out.schema.names, "t"]) if kept else out

    schema = [*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)), *(T.StructField(f"n{k}", t) for k, (_, t) in enumerate(added)), *(T.StructField("t", f.dataType) for f in kept)]
    names = [*(f.name for f in fields), *(n for n, _ in added), *(f.name for f in kept)]
    return plain.mapInArrow(run, T.StructType(schema)).toDF(*names).select(*(quoted(c) for c in (*(f.name for f in docs.schema if f.name in keep), *(n for n, _ in added))))


_LET_GO: dict[str, Callable[[], None]] = {}


def on_other_work(name: str, let_go: Callable[[], None]) -> None:
    """``let_go`` frees what the operator ``name`` keeps in a Python worker; called when another one's work begins there."""
    _LET_GO[name] = let_go


def begin_work(name: str) -> None:
    """To be called where an operator's Python work begins: workers serve many stages, and freed memory goes back."""
    for other, let_go in _LET_GO.items():
        if other != name:
            let_go()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than on Linux with glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc_fold(doc_id: str | Column, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; NULL for a NULL id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % parts


def hashed_share(seed: int, *cols: str | Column) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / float(1 << 53)


def text_runs(arr: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of whole values of about ``limit`` bytes in a string array."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(arr):
        before = int(ends[at - 1]) if at else 0
        end = min(max(int(np.searchsorted(ends, before + limit, "right")), at + 1), len(arr))
        yield at, end
        at = end


def utf8_slices(arr: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of whole values of about ``limit`` bytes.

    Yields (first, last + 1, bytes, offsets); a NULL counts as an empty value.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = (arr.fill_null("") if arr.null_count else arr).cast(pa.large_binary())
    n = len(arr)
    if not n:
        return
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, arr.offset * 8)
    blob = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, blob[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def numbered(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc, doc_id, text) with a unique ``doc`` in the order of ids, then texts; NULL ids come first."""
    thin = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    odd = thin.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null").limit(1).count()
    if not odd:
        return thin.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    key = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return scratch.put(thin.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key, "text").withColumn("doc", F.monotonically_increasing_id()), "numbered")
