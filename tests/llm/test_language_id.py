import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.llm.common import map_rows
from rowsmith.llm.language_id import codebook, fit, fit_counts, identify, predict
from rowsmith.llm.queries import op10_language_id

from .helpers import docs, odd_rows

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    out = [r for r in op10_language_id(spark, MID).collect() if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(spark):
    rows = [(100 + i, "the words of the one", "en", "a") for i in range(8)] + [(200 + i, "die worte und der satz", "de", "a") for i in range(8)] + odd_rows()
    out = identify(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {1, 2, 3} <= und and all(r.score == 0 for r in out if r.lang_pred == "und")
    by = {r.doc_id: r.lang_pred for r in out}
    assert by[100] == "en" and by[203] == "de"
    assert all(r.lang_pred == "und" for r in identify(docs(spark, [(1, "text", None, None)])).collect())
    assert identify(docs(spark, [])).count() == 0


def test_letters_of_other_scripts_are_letters(spark):
    train = docs(spark, [(i, "слова и буквы", "ru", "a") for i in range(3)] + [(9, "words", "en", "a")])
    model = fit(train, "text", "lang", "doc_id")
    out = {r.doc_id: r.lang_pred for r in predict(docs(spark, [(1, "буквы"), (2, "12 — 34 …")]), model).collect()}
    assert out == {1: "ru", 2: "und"}


def test_codebooks():
    for n in (2, 3, 4, 6, 12, 40):
        book = codebook(n)
        apart = (book[:, None] != book[None]).sum(2)
        assert min(apart[i, j] for i in range(n) for j in range(i)) >= (book.shape[1] + 1) // 4
    assert fit_counts([], __import__("numpy").zeros((0, 1 << 15))).languages == []


def test_a_kept_text_goes_to_the_worker_once_and_some_mb_at_a_time(spark):
    seen = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            assert batch.num_columns == 2 and batch.column(1).nbytes < (5 << 20)  # once the text was a column of its own as well
            seen.add(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64())], ["c0", "n0"])

    table = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("word "), 1000)).alias("text"))
    out = map_rows(table, work, "text", ["id", "text"], [("n", T.LongType())])
    assert out.columns == ["id", "text", "n"]
    want = [(i, None, None) if i % 7 == 0 else (i, "word " * 1000, 5000) for i in range(3000)]
    assert sorted(map(tuple, out.collect())) == want
    assert seen.value > 3
    assert map_rows(table, lambda b: work(b), "text", ["id"], [("n", T.LongType())]).columns == ["id", "n"]
