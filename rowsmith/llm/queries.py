"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import flag_documents

    return flag_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP3_SQL = """
WITH dw AS (
    SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
),
bw AS (
    SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS p
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 13
),
agreeing AS (SELECT doc_id, item_id, d.p - b.p AS shift, b.p AS p FROM dw d JOIN bw b USING (w)),
windows AS (
    SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n
    FROM agreeing
),
pairs AS (SELECT doc_id, item_id, max(n) AS matched FROM windows WHERE n >= 11 GROUP BY ALL),
flags AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items, max(matched) AS matched FROM pairs GROUP BY 1)
SELECT doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(f.items, []) AS items, coalesce(f.matched, 0)::INTEGER AS matched
FROM documents LEFT JOIN flags f USING (doc_id)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images: the pictures are drawn from the markup of ``pages``, a block of text as a row of bars."""
    from .images import copies, render

    return copies(read(spark, sf_dir, "pages"), "page_id", "html", render).withColumnRenamed("image_id", "page_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(read(spark, sf_dir, "documents"), temperature=0.5, epochs=1.0, seed="mix")
    return mixed.select("doc_id", "source", "lang", "text", F.col("copies"), F.col("copy"), "shuffle_key")


OP6_SQL = """
WITH RECURSIVE held AS (SELECT coalesce('=' || source, 'null') AS k, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
rates AS (SELECT k, pow(n, 0.5) / n * (1.0::DOUBLE * (SELECT sum(n) FROM held) / (SELECT sum(pow(n, 0.5)) FROM held)) AS rate FROM held),
steps AS (
    SELECT k, rate, 0 AS i, -rate AS l, exp(-rate) AS c FROM rates
    UNION ALL
    SELECT k, rate, i + 1, l + ln(rate) - ln(i + 1.0::DOUBLE), c + exp(l + ln(rate) - ln(i + 1.0::DOUBLE)) FROM steps
    WHERE i < ceil(rate + 12 * sqrt(rate) + 30)
),
lists AS (SELECT k, list(c) AS cs FROM steps GROUP BY k),
units AS (
    SELECT *, coalesce('=' || source, 'null') AS k,
        ('0x' || substr(md5('mix#' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM documents
),
drawn AS (SELECT u.*, len(list_filter(cs, lambda c: c <= u.u))::INTEGER AS copies FROM units u JOIN lists USING (k))
SELECT doc_id, source, lang, text, copies, copy::INTEGER AS copy,
    md5('mix#' || coalesce(doc_id::VARCHAR, 'null') || '#' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM drawn WHERE copies > 0)
"""


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_records import encode_and_read

    return encode_and_read(read(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=8)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_digest

    return dedup_digest(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_decontaminate, op4_simhash, op5_image_copies, op6_mixing, op7_token_records, op8_sharding, op9_substring_dedup, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op6_mixing": OP6_SQL}
