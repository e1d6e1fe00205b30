"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; the tokens at its 1s are hashed together, those at its 0s are ignored.
A document and a benchmark item that agree in at least ``WINDOW - SUBSTITUTIONS`` of ``WINDOW`` aligned tokens always
share a hash of one of the two masks: every placing of two substitutions in 13 tokens leaves a shifted copy of one mask
free (a test tries them all). Hits of the join are then verified token by token, in all windows around the hit.

Everything is DataFrame functions: tokens, hashes and windows are array expressions of one row, exploded only to be
joined. The benchmark's index is broadcast when its counted tokens are few, and joined by a shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, unused

# Masks that together see every window of 13 tokens with 2 substitutions.
MASKS = ("1111001001", "10001011011")
WINDOW = 13
SUBSTITUTIONS = 2
#: A benchmark of more tokens than this (8 bytes each, and some 40 for each of two index rows) is not broadcast.
MAX_BROADCAST_TOKENS = 500_000
#: Ids of documents with hits are broadcast up to this many, so that texts need not move.
MAX_BROADCAST_IDS = 200_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; none for a NULL text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_hashes(tokens: Column, number: int) -> Column:
    """The hash of mask ``number`` at every place where it fits."""
    mask = MASKS[number]
    picks = [k for k, c in enumerate(mask) if c == "1"]
    places = F.sequence(F.lit(0), F.size(tokens) - len(mask))
    hashes = F.transform(places, lambda i: F.xxhash64(F.lit(number), *(F.get(tokens, i + k) for k in picks)))
    return F.when(F.size(tokens) >= len(mask), hashes).otherwise(F.array().cast("array<bigint>"))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and (at, h) for every place of every mask; ``rows`` has ``tokens``. ``at`` counts through the masks' places.

    The outer form of the generator keeps the planner from repeating the array's expression in a filter below it.
    """
    arrays = rows.select(*keep, F.size("tokens").alias("n"), F.concat(*(seed_hashes(F.col("tokens"), m) for m in range(len(MASKS)))).alias("_all"))
    return arrays.select(*keep, "n", F.posexplode_outer("_all").alias("at", "h")).filter("h is not null")


def _place() -> tuple[Column, Column]:
    """Mask number and place, from the count ``at`` through the places of all masks in a row of ``n`` tokens."""
    mask, place, before = F.lit(len(MASKS) - 1), F.col("at"), F.lit(0)
    starts = [before]
    for m in MASKS[:-1]:
        before = before + F.greatest(F.col("n") - (len(m) - 1), F.lit(0))
        starts.append(before)
    for k in reversed(range(1, len(MASKS))):
        mask = F.when(F.col("at") < starts[k], k - 1).otherwise(mask)
    place = F.col("at") - starts[0]
    for k in range(1, len(MASKS)):
        place = F.when(F.col("at") >= starts[k], F.col("at") - starts[k]).otherwise(place)
    return mask, place


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched): for each document and item that agree in a window, the most tokens that agree in one.

    A window is ``WINDOW`` consecutive tokens, aligned one to one; at most ``SUBSTITUTIONS`` of them may differ. Items
    with fewer tokens than a window can't fill one and match nothing. NULL or empty texts have no tokens. Rows that
    share an id count as one document (NULL ids too), items that share an id as one item. Empty tables: no rows.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select(quoted(item_col).alias("item_id"), token_hashes(quoted(item_text_col)).alias("tokens"))
    items = scratch.put(items.filter(F.size("tokens") >= WINDOW), "items")
    tokens = items.agg(F.sum(F.size("tokens"))).first()[0] or 0
    small = tokens <= MAX_BROADCAST_TOKENS
    mask, place = _place()
    index = _seeds(items, ["item_id"]).select("h", "item_id", place.alias("item_place"), F.col("n").alias("item_size"))
    index = scratch.put(index.distinct(), "index")
    texts = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    seeds = _seeds(texts.select("doc_id", token_hashes(F.col("text")).alias("tokens")), ["doc_id"])
    hits = seeds.join(F.broadcast(index) if small else index, "h")
    # hits on one diagonal of a document and an item are verified together
    lines = hits.select("doc_id", "item_id", (place - F.col("item_place")).alias("shift"), "item_size").distinct()
    lines = scratch.put(lines.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("item_id", "shift", "item_size")).alias("lines")), "lines")
    few = lines.count() <= MAX_BROADCAST_IDS and small
    hit = texts.join(F.broadcast(lines) if few else lines, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "lines", token_hashes(F.col("text")).alias("tokens"))
    # of a document only the tokens beside the item go on: a long text with many hits is not copied for each of them
    beside = lambda d: F.slice("tokens", F.greatest(d["shift"], F.lit(0)) + 1, F.greatest(d["item_size"] + F.least(d["shift"], F.lit(0)), F.lit(0)))
    cut = F.transform("lines", lambda d: F.struct(d["item_id"].alias("item_id"), F.greatest(-d["shift"], F.lit(0)).alias("skip"), beside(d).alias("part")))
    hit = hit.select("doc_id", F.explode_outer(cut).alias("line")).select("doc_id", "line.*")
    other = items.select(F.col("item_id").alias("_item"), F.col("tokens").alias("item_tokens"))
    pairs = hit.join(F.broadcast(other) if small else other, F.col("item_id").eqNullSafe(F.col("_item")))
    # agreement of each aligned token, then its sums over windows; a window may reach over the document's ends
    same = F.transform("item_tokens", lambda t, j: F.when(F.get("part", j - F.col("skip")) == t, 1).otherwise(0))
    pairs = pairs.select("doc_id", "item_id", same.alias("same"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - (WINDOW - 1)), lambda s: F.aggregate(F.slice("same", s, WINDOW), F.lit(0), lambda n, x: n + x))
    found = pairs.select("doc_id", "item_id", F.array_max(sums).alias("matched")).filter(F.col("matched") >= WINDOW - SUBSTITUTIONS)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def flag_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, ``contaminated``, ``items`` (ids, ascending), ``matched`` (most tokens that agree in a window, else 0).

    NULL ids share one flag, as do rows that share an id; NULL, empty and short texts have no window. Other columns of
    ``docs``, whatever their names, are not looked at. Empty tables: no rows, or no flags.
    """
    scratch = Scratch(docs.sparkSession, "flags")
    pairs = matches(docs, benchmark, id_col, text_col, item_col, item_text_col)
    flags = scratch.put(pairs.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("item_id"))), lambda i: i["item_id"]).alias("items"), F.max("matched").alias("matched")), "flags")
    left = docs.select(quoted(id_col).alias("doc_id"))
    right = flags.withColumnRenamed("doc_id", "_id")
    none = F.array().cast(flags.schema["items"].dataType)
    return left.join(right, left["doc_id"].eqNullSafe(right["_id"]), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("matched", F.lit(0)).alias("matched")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has a window of a benchmark item.

    Texts are told apart by a 64-bit hash of their own, not by their ids: of rows that share an id, or have none, only
    those go whose text is contaminated. NULL, empty and short texts stay; very long ones are looked at as a whole. All
    columns are kept as they are, whatever their names. Empty tables: nothing goes.
    """
    scratch = Scratch(docs.sparkSession, "flagged")
    own, bad = unused(docs, "hash", "bad")
    texts = docs.select(F.xxhash64(quoted(text_col)).alias("doc_id"), quoted(text_col).alias("text"))
    found = scratch.put(matches(texts, benchmark).select(F.col("doc_id").alias(bad)).distinct(), "ids")
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST_IDS else found
    kept = docs.withColumn(own, F.xxhash64(quoted(text_col)))
    return kept.join(found, F.col(own) == F.col(bad), "left_anti").select(*(quoted(c) for c in docs.columns))
