"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of the digests, one for each partition and added up, name every digest that may
have more than rows/(COUNTERS+1) rows. Those candidates are counted exactly and their winners, at most
COUNTERS rows of about 100 bytes, are broadcast: rows of a hot digest get their answer where they are
read and are never shuffled. All other digests meet in an ordinary shuffle, where no group is hot.

Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]. Of equal texts the row
with the most code points stays, then the smallest doc_id (null last), then the first row read.
Null text counts as empty, so null, empty and blank texts are one group. Rows that repeat a doc_id are
rows of their own. An empty table gives an empty result. Only the id and the text column are read, so
other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

COUNTERS = 4096
BLANKS = "[ \\t-\\r]+"


def text_digest(text: str = "text"):
    """SHA-256 (hex) of the text without blanks; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, ""), 256)


class MisraGries:
    """Frequent items in a stream: counts are too low by at most n/(k+1)."""

    def __init__(self, k: int):
        self.k, self.counts = k, {}

    def add(self, items: np.ndarray) -> None:
        values, counts = np.unique(items, return_counts=True)
        held = self.counts
        for v, c in zip(values.tolist(), counts.tolist()):
            held[v] = held.get(v, 0) + c
        if len(held) > self.k:
            # taking the (k+1)-th largest count from all is what so many single decrements would do
            cut = np.partition(np.fromiter(held.values(), np.int64, len(held)), -self.k - 1)[-self.k - 1]
            self.counts = {v: c - int(cut) for v, c in held.items() if c > cut}


def _summary(k: int):
    def run(batches):
        found = MisraGries(k)
        for b in batches:
            found.add(b.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"item": pa.array(list(found.counts), pa.int64()), "seen": pa.array(list(found.counts.values()), pa.int64())})

    return run


def frequent(items: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(item, seen) of at most k items; every item of more than n/(k+1) rows is among them. items: one bigint column."""
    parts = items.mapInArrow(_summary(k), "item long, seen long")
    return parts.groupBy("item").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "item").limit(k)


def _winner():
    order = F.struct(F.col("n_points"), F.col("doc_id").isNotNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), -F.col("row_no"))
    return F.max_by(F.struct("doc_id", "row_no"), order)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("text_sha256"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"), F.monotonically_increasing_id().alias("row_no"),
    )
    rows = scratch.table(rows, "digests")
    item = F.xxhash64("text_sha256")
    hot = F.broadcast(frequent(rows.select(item.alias("item")), counters).select("item"))
    verified = (
        rows.withColumn("item", item).join(hot, "item", "left_semi").groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), _winner().alias("winner")).where("group_size > 1")
    )
    verified = scratch.table(verified, "winners")  # at most as many rows as counters, but for digests of equal xxhash64
    split = rows.join(F.broadcast(verified), "text_sha256", "left")
    groups = Window.partitionBy("text_sha256").orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"), "row_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (
        split.where("winner is null").select("doc_id", "text_sha256", "n_points", "row_no")
        .withColumn("group_size", F.count("*").over(groups)).withColumn("winner", F.first(F.struct("doc_id", "row_no")).over(groups))
    )
    both = split.where("winner is not null").select(*rest.columns).unionByName(rest)
    return both.select("doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("winner.row_no")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that repeat both id and text leave one, the longest.

    What is taken away is a table (id, digest) of the losers alone. While it is small Spark broadcasts it, by the size of its files,
    and no text is shuffled; beyond that it is an ordinary join.
    """
    half = lambda digest: F.unhex(F.substring(digest, 1, 32))  # noqa: E731 - 128 bits beside the id
    key = {"__id": F.col(id_col).cast("long"), "__sha": half(text_digest(text_col))}
    decided = exact_dedup(docs, id_col, text_col).where("group_size > 1").groupBy("doc_id", half(F.col("text_sha256")).alias("text_sha256")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    decided = scratch.table(decided.where("not kept or n > 1"), "losers").alias("l")
    same = F.expr("__id <=> l.doc_id and __sha = l.text_sha256")
    gone, twice = decided.where("not kept"), decided.where("kept")
    rows = docs.withColumns(key).join(gone, same, "left_anti")
    if not twice.head(1):
        return rows.select(*docs.columns)
    first = Window.partitionBy("__id", "__sha").orderBy(F.desc(F.length(F.coalesce(F.col(text_col), F.lit("")))))
    once = rows.join(twice, same, "left_semi").withColumn("__no", F.row_number().over(first)).where("__no = 1")
    return rows.join(twice, same, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents
), w AS (
  SELECT s, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY s
)
SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, d.s AS text_sha256 FROM d JOIN w USING (s)
"""
