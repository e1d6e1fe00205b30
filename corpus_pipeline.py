"""A training-data pipeline over ``documents``: language ID, near-duplicates, decontamination, mixing, token records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import decontaminate, language_id, mixing, simhash, token_records
from rowsmith.llm.common import Scratch, crc_fold, quoted
from rowsmith.llm.queries import END_ID, tokenizer_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language ID rejects: no text, no letter, or two languages about equally likely.

    Repeated rows are judged alike, NULL ids and sources don't matter, long texts are read as a whole; all columns are
    kept, whatever their names. Where no row has a language nothing can be learned and all go; an empty table stays so.
    """
    model = language_id.fit(docs.filter(crc_fold("doc_id", 4) != 2), "text", "lang", "doc_id")
    return language_id.drop_unknown(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the least id (NULL last).

    Near: five-word shingles of a similarity of 0.8 or more. Texts without words (NULL, empty, blank) are one group; of
    rows that share an id each stays whose text is alone; all columns are kept, whatever their names.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item, told by their own text: rows that share an id stay or go alone.

    NULL, empty and short texts stay; all columns are kept, whatever their names; an empty table stays so.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that a source's share goes with the square root of its size.

    NULL sources are a source; rows without an id, or of one id, are repeated alike; columns of any name are kept.
    """
    return mixing.mix_sources(docs, temperature=0.5, epochs=1.0, seed="mix").select(*(quoted(c) for c in docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token records and return what is read back of them, a row for each record.

    NULL and empty texts are the end id alone, rows that share an id follow one another, NULL ids come first.
    """
    return token_records.encode_and_read(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language ID", identify_languages),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token records", write_tokens),
]

#: SQL expresses neither the language model nor the fingerprints; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again as the next one's."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
