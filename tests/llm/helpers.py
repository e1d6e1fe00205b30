"""Small fixtures for the operators of rowsmith.llm, and the plain forms that they are held against."""

import zlib

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r + (None, None))[:4] for r in rows]
    return spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in full], DOCS)


def crc(text):
    return zlib.crc32((text or "").encode())


def odd_rows():
    """NULLs in any column, empty, blank and very long texts, ties and repeated rows."""
    return [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, "  \t\n ", "en", "a"),
        (4, "same words here for two rows of text", "en", None),
        (4, "same words here for two rows of text", "en", None),
        (None, "a row without an id", "fr", "b"),
        (5, "long " * 60_000, "en", "a"),
        (6, "same words here for two rows of text", "de", "b"),
    ]
