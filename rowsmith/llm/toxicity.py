"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models, one of toxic and one of ordinary texts, give each word a log-likelihood after the word before
it; a text is scored by the differences toxic minus ordinary, normalised by length over the whole text and over its most
toxic stretch of ``SPAN`` words. A logistic function, fitted on labelled texts that the models have not seen, turns both
into a score.

Class counts are continuation counts, of the different words that an expression follows, so a passage copied into many
texts counts about once. The lowest order is shared: its counts are of the documents that have a word, labelled or not,
over all whole texts, so they grow with the input (preceding words would have to be told apart by all different word
pairs of the corpus, which take more than twice its size in shuffles). They are the same for both classes, so copies
favour neither, and the mass set aside for it is the same in both classes. A word that neither class has then
gets equal likelihoods whatever its shared count, and one that a class has seldom is drawn towards equal ones the more,
the more often all documents have it. With class counts c, shared counts N, discount D, shared mass m:

    P(w) = (1 - m) * max(c(w) - D, 0) / sum + m * N(w) / sum        P(w | v) likewise over P(w)

Where only one class has words after v, both back off to P(w): the mass set aside is then the same on both sides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, begin_work, crc_fold, hashed_share, map_rows, quoted, unused

WORD = re.compile(r"[^\W_]+")
#: Labelled texts of each class that fitting reads at most, about, chosen by a hash of their ids; a fifth calibrates.
TRAIN_DOCS_PER_CLASS = 6000
#: An expression is kept when it follows so many different words (copies of a passage don't add any), and a single word
#: also only when so many training texts hold it (one that a text repeats does not count again).
MIN_CONTEXTS = 5
MIN_DOCS = 5
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
SPAN = 4
DISCOUNT = 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Model:
    """Log-likelihood differences of single words and word pairs (keys joined by a space), and the calibration."""

    single: dict[str, float]
    pair: dict[str, float]
    weights: tuple[float, float, float]


def _difference(toxic: float, ordinary: float) -> float:
    return math.log(toxic) - math.log(ordinary)


def likelihoods(single: dict[str, tuple[int, int]], pair: dict[tuple[str, str], tuple[int, int]], shared: dict[str, int], total: int) -> tuple[dict[str, float], dict[str, float]]:
    """Differences from the kept toxic and ordinary counts, and the ``shared`` counts of single words, ``total`` over all words."""
    kept = [sum(max(v[c] - DISCOUNT, 0) for v in single.values()) for c in (0, 1)]
    seen = sum(v[0] + v[1] for v in single.values())
    mass = min(max(DISCOUNT * 2 * len(single) / max(seen, 1), 1e-6), 0.5)  # set aside: the discounts

    def p_single(w: str, c: int) -> float:
        return (1 - mass) * max(single[w][c] - DISCOUNT, 0) / max(kept[c], 1e-9) + mass * max(shared.get(w, 0), 1) / max(total, 1)

    probs = {w: (p_single(w, 0), p_single(w, 1)) for w in single}
    heads: dict[str, list[float]] = {}
    for (v, _), counts in pair.items():
        h = heads.setdefault(v, [0.0, 0.0, 0.0, 0.0])
        for c in (0, 1):
            h[c] += max(counts[c] - DISCOUNT, 0)
            h[2] += counts[c]
        h[3] += 1
    pairs = {}
    for (v, w), counts in pair.items():
        h = heads[v]
        if not h[0] or not h[1]:
            continue
        m = min(max(DISCOUNT * 2 * h[3] / max(h[2], 1), 1e-6), 0.5)
        p = [(1 - m) * max(counts[c] - DISCOUNT, 0) / h[c] + m * probs[w][c] for c in (0, 1)]
        pairs[f"{v} {w}"] = _difference(*p)
    return {w: _difference(*p) for w, p in probs.items()}, pairs


def features(words: list[str], single: dict[str, float], pair: dict[str, float]) -> tuple[float, float]:
    """Length-normalised difference of the whole text and of its most toxic stretch; 0 and 0 without words.

    In stretches a word counts where the text has it first, so that a word said many times over makes none toxic.
    """
    if not words:
        return 0.0, 0.0
    # a pair that is kept speaks for its second word, else that word alone; what is in no model has no difference
    one = single.get
    x = [one(words[0], 0.0)]
    said: set[str] = set()
    x += [d if (d := pair.get(b)) is not None else one(w, 0.0) for b, w in zip(map(" ".join, zip(words, words[1:])), words[1:])]
    sums = np.concatenate(([0.0], np.cumsum([v if w not in said and not said.add(w) else 0.0 for v, w in zip(x, words)])))
    span = min(SPAN, len(x))
    return math.fsum(x) / len(x), float((sums[span:] - sums[:-span]).max() / SPAN)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of a logistic function by Newton steps with a small ridge."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 0.05 * w * np.array([0, 1, 1])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + 0.05 * np.eye(3), grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def shared_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): how many of the whole texts of ``docs`` hold each word.

    NULL, empty and word-less texts have none; a word that a text repeats counts once, rows of equal texts count each.
    A task hands on a row for each of its words, so a frequent word is no more than a row of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("toxicity")
        n: Counter[str] = Counter()
        handed = lambda: pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["w", "n"])
        for batch in batches:
            for t in batch.column(0):
                n.update(set(words_of(t.as_py())))
                if len(n) > HELD_WORDS:
                    yield handed()
                    n = Counter()
        yield handed()

    return docs.select(quoted(text_col).alias("text")).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_DOCS_PER_CLASS, seed: int = 5) -> Model:
    """Fit on a bounded sample of the labelled rows: whole texts of about ``per_class`` documents of each class.

    The shared counts are taken over every text of ``docs``, in Spark; what the driver collects is held to the words of
    the sample. Rows without a label, with a label other than 0 and 1, or without an id are not used; of an id labelled more than
    once the greatest label counts. Without labelled texts of both classes every text gets one score.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("y"))
    held = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(held) < 2:
        return Model({}, {}, (math.log(0.99 / 0.01) if held.get(1) else math.log(0.01 / 0.99), 0.0, 0.0))
    share = F.when(F.col("y") == 1, min(1.0, per_class / held[1])).otherwise(min(1.0, per_class / held[0]))
    chosen = known.filter(hashed_share(seed, "_id") < share)
    if min(held[1], per_class) + min(held[0], per_class) <= 4 * per_class:  # a bounded sample: some 100 KB of ids
        chosen = F.broadcast(chosen)
    scratch = Scratch(spark, "toxicity")
    rows = docs.join(chosen, docs[id_col] == chosen["_id"]).select(F.col("y").cast("int").alias("y"), F.col(text_col).alias("text"), (hashed_share(seed + 1, "_id") < 0.2).alias("cal"))
    rows = scratch.put(rows, "rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("toxicity")
        seen: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            for y, t, cal in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                w = words_of(t.as_py()) if not cal else []
                bit = 1 if y else 2
                for g in zip(["", "", *w], ["", *w], w):
                    seen[g] = seen.get(g, 0) | bit
                if len(seen) > 300_000:
                    yield _grams(seen)
                    seen = {}
        yield _grams(seen)

    def spread_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for t, cal in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                n.update(set(words_of(t.as_py()) if not cal else ()))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["at", "docs"])

    has = lambda bit: F.max(F.col("s").bitwiseAND(bit)).cast("int")
    triples = rows.mapInArrow(count, "u string, v string, w string, s int").groupBy("u", "v", "w").agg(has(1).alias("t"), (has(2) / 2).cast("int").alias("o"))
    pairs = scratch.put(triples.groupBy("v", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "pairs")
    spread = rows.mapInArrow(spread_of, "at string, docs bigint").groupBy("at").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= MIN_DOCS)
    words = scratch.put(pairs.groupBy("w").agg(F.sum(F.signum("t")).cast("long").alias("t"), F.sum(F.signum("o")).cast("long").alias("o")).join(spread, F.col("w") == F.col("at"), "left_semi"), "words")
    often = lambda df: df.filter(F.col("t") + F.col("o") >= MIN_CONTEXTS)
    # bounded by the sample, as are the class counts
    words, counts = often(words), scratch.put(shared_counts(docs, text_col), "shared")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = words.join(counts.select(F.col("w").alias("x"), "n"), F.col("w") == F.col("x"), "left").select("w", "t", "o", "n").orderBy("w").collect()
    single, shared = {r["w"]: (r["t"], r["o"]) for r in found}, {r["w"]: r["n"] or 0 for r in found}
    near = often(pairs).orderBy("v", "w").toLocalIterator()
    pair = {(r["v"], r["w"]): (r["t"], r["o"]) for r in near if r["v"] in single and r["w"] in single}
    one, two = likelihoods(single, pair, shared, total)
    cast = spark.sparkContext.broadcast((one, two))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(y, *features(words_of(t.as_py()), *cast.value)) for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*got, strict=True), (pa.int32(), pa.float64(), pa.float64()), strict=True)], ["y", "whole", "most"])

    cal = rows.filter("cal").select("y", "text").mapInArrow(measure, "y int, whole double, most double").collect()
    if len({r["y"] for r in cal}) < 2:  # too few to set aside: fall back on what the models were made of
        cal = rows.select("y", "text").mapInArrow(measure, "y int, whole double, most double").collect()
    scratch.drop("rows", "pairs", "words", "shared")
    if not cal:
        return Model(one, two, (-4.0, 1.0, 8.0))
    cal.sort()
    y = np.array([r["y"] for r in cal], float)
    return Model(one, two, _calibrate(np.array([(r["whole"], r["most"]) for r in cal]), y))


def _grams(seen: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
    cols = list(zip(*seen, strict=True)) if seen else [(), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(seen.values(), pa.int32())], ["u", "v", "w", "s"])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``keep_text``) and ``score``, ``whole``, ``most``.

    NULL, empty and word-less texts have differences of 0. Where ``docs`` has a column of one of these names, the added
    one gets underscores before its name.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("toxicity")
        m = cast.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got = np.array([features(words_of(t.as_py()), m.single, m.pair) for t in texts]).reshape(-1, 2)
            b0, b1, b2 = m.weights
            p = 1 / (1 + np.exp(-np.clip(b0 + b1 * got[:, 0] + b2 * got[:, 1], -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array(got[:, 0]), pa.array(got[:, 1])], [*batch.schema.names[:-1], "n0", "n1", "n2"])

    keep = [c for c in docs.columns if keep_text or c != text_col]
    return map_rows(docs, run, text_col, keep, [(n, T.DoubleType()) for n in unused(docs, "score", "whole", "most")])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Learn from labels of rows with crc32(id) mod ``folds`` other than ``held``, score all: doc_id, held_out, score, predicted, whole, most.

    Labels, languages, sources and ids are no input of a score. A NULL id counts as held out. Repeated rows are scored
    alike; an empty table gives an empty result, and no usable labels give every text the same score.
    """
    model = fit(docs, labels.filter(crc_fold(id_col, folds) != held), id_col, text_col, label_col)
    fold = crc_fold(id_col, folds)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold == held, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    out = score(thin, model, "text", keep_text=False)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "whole", "most")
