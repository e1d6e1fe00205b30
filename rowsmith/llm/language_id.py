"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier for each bit says, from byte trigrams, on which side of that bit's
split of the languages a text lies. A text gets the language whose codeword has the least loss against the classifiers'
margins, each bit's loss weighted by how well that bit separates the training languages. Two codewords of nearly the
same loss make the text ambiguous.

Texts are case-folded for ASCII, and every run of ASCII non-letters counts as one space. All counting is done on the
bytes of a whole Arrow batch with numpy; no text is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin_work, crc_fold, hashed_share, map_rows, quoted, unused, utf8_slices

#: Hashed trigram buckets; the weights take BUCKETS * bits * 4 bytes.
BUCKETS = 1 << 15
#: Fitting reads about so many documents of each language at most, chosen by a hash of their ids.
TRAIN_DOCS_PER_LANGUAGE = 800
#: A text is ambiguous when its score, the share of the best codeword against the second, is below this.
AMBIGUOUS_BELOW = 0.6

FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
#: Columns that predictions add.
ADDED = ("lang_pred", "score", "ambiguous")
LETTER = re.compile(r"[^\W\d_]")


def _trigrams(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram of the folded texts, and each text's first and last + 1 trigram."""
    b = FOLD[blob]
    space = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(b)]] = True
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
    ids = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    ids >>= np.uint32(32 - 15)
    lo = np.minimum(at[:-1], len(ids))
    return ids, lo, np.clip(at[1:] - 2, lo, len(ids))


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all splits of the languages up to 6 languages, else the best of some seeded random books."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        cols = [[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for i in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(64):
        book = np.where(rng.random((n, bits)) < 0.5, -1, 1).astype(np.int8)
        book = book[:, np.abs(book.sum(0)) < n]
        apart = (book[:, None, :] != book[None, :, :]).sum(2) + np.eye(n, dtype=int) * 10**6
        if apart.min() > most:
            best, most = book, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    quality: np.ndarray


def fit_counts(languages: list[str], counts: np.ndarray) -> Model:
    """The model from trigram counts, a row for each language."""
    n = len(languages)
    code = codebook(n)
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    weights, scale, quality = [], [], []
    for column in code.T:
        up, down = p[column > 0], p[column < 0]
        w = np.log(up.mean(0)) - np.log(down.mean(0)) if len(down) else np.zeros(BUCKETS)
        margins = p @ w * column  # how far each language's own texts lie on their side
        weights.append(w.astype(np.float32))
        scale.append(max(float(np.abs(margins).mean()), 1e-6) if n else 1.0)
        quality.append(max(float(margins.min()), 0.05 * scale[-1]) if len(down) else 1.0)
    q = np.array(quality)
    return Model(languages, code, np.array(weights, np.float32), np.array(scale), q / q.sum() if n else q)


def fit(train: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int = TRAIN_DOCS_PER_LANGUAGE, seed: int = 11) -> Model:
    """Fit on a bounded sample: about ``per_language`` documents of each language, whole texts. Rows without text or language are not used."""
    rows = train.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    held = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    if not held:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((1, BUCKETS), np.float32), np.ones(1), np.ones(1))
    languages = sorted(r["lang"] for r in held)
    index = {lang: i for i, lang in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for r in held for x in (r["lang"], min(1.0, per_language / r["n"]))])
    sample = rows.filter(hashed_share(seed, F.col(id_col)) < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("language_id")
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, _, blob, offsets in utf8_slices(batch.column(1)):
                ids, lo, hi = _trigrams(blob, offsets)
                for k, (a, z) in enumerate(zip(lo, hi, strict=True)):
                    have = sums.setdefault(int(langs[first + k]), np.zeros(BUCKETS, np.int64))
                    np.add.at(have, ids[a:z], 1) if z - a < 2000 else have.__iadd__(np.bincount(ids[a:z], minlength=BUCKETS))
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(have[at])], ["l", "b", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    for r in sample.mapInArrow(count, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["l"], r["b"]] = r["n"]
    return fit_counts(languages, counts)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each row of margins and its score, by loss-weighted decoding with the logistic loss."""
    z = margins / model.scale
    loss = np.stack([(np.logaddexp(0, -2 * z * word) * model.quality).sum(1) for word in model.code], 1)
    best = loss.argmin(1)
    if loss.shape[1] == 1:
        return best, np.ones(len(best))
    two = np.partition(loss, 1, axis=1)
    return best, 1 / (1 + np.exp(-np.clip(8 * (two[:, 1] - two[:, 0]), 0, 50)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``keep_text``) and ``lang_pred``, ``score``, ``ambiguous``.

    ``lang_pred`` is ``und``, with score 0, for a NULL text and one without a letter, and where no language was
    learned. A text too short for a trigram has margins of 0 and gets a low score. Ties go to the language that sorts
    first. Where ``docs`` has a column of one of these names, the added one gets underscores before its name.
    """
    spark = docs.sparkSession
    cast = spark.sparkContext.broadcast(model)  # BUCKETS * bits * 4 bytes: 0.9 MB for 4 languages, 11 MB for 256, 13 for 1000

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("language_id")
        m = cast.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            best, share, ok = [], [], []
            for first, end, blob, offsets in utf8_slices(texts):
                ids, lo, hi = _trigrams(blob, offsets)
                size = np.maximum(hi - lo, 1)
                margins = np.empty((end - first, len(m.weights)))
                for k, w in enumerate(m.weights):
                    sums = np.concatenate(([0.0], np.cumsum(w[ids], dtype=np.float64)))
                    margins[:, k] = (sums[hi] - sums[lo]) / size
                # a text with an ASCII letter has a letter; of the others each is looked at
                letters = np.concatenate(([0], np.cumsum((FOLD[blob] >= 97) & (blob < 128))))[offsets]
                has = np.diff(letters) > 0
                for k in np.flatnonzero(~has):
                    t = texts[first + int(k)].as_py()
                    has[k] = bool(t and LETTER.search(t))
                b, s = decode(m, margins) if m.languages else (np.zeros(end - first, int), np.zeros(end - first))
                has &= bool(m.languages)
                best += [m.languages[i] if h else "und" for i, h in zip(b, has, strict=True)]
                share.append(np.where(has, s, 0.0))
            s = np.concatenate(share) if share else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(s), pa.array(s < AMBIGUOUS_BELOW)], [*batch.schema.names[:-1], "n0", "n1", "n2"])

    keep = [c for c in docs.columns if keep_text or c != text_col]
    added = list(zip(unused(docs, *ADDED), (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))
    return map_rows(docs, score, text_col, keep, added)


def drop_unknown(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, with all columns as they are, without rows of no language (NULL texts, texts without a letter) or of two about equally likely."""
    lang, _, ambiguous = unused(docs, *ADDED)
    return predict(docs, model, text_col).filter((F.col(lang) != "und") & ~F.col(ambiguous)).select(*(quoted(c) for c in docs.columns))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows with crc32(id) mod ``folds`` other than ``held``, predict all: doc_id, held_out, lang_pred, score, ambiguous.

    Rows with a NULL id count as held out; an empty table gives an empty result, and where no language can be learned all
    is ``und``. Repeated rows are predicted alike. Labels, sources and ids are no input of a prediction.
    """
    fold = crc_fold(id_col, folds)
    model = fit(docs.filter(fold != held), text_col, lang_col, id_col)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold == held, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(thin, model, "text", keep_text=False)
