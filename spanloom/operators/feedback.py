"""The feedback loop's dataflow: deduplicated records, samples, guards, privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import line_around, with_line
from .evaluate import with_overlap, without_overlap

PRIVATE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "digits": r"[0-9]{6,}"}


def new_records(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (doc_id, name) of the batch whose name is new, the smallest doc_id of each."""
    return batch.join(known.select("name"), "name", "left_anti").groupBy("name").agg(F.min("doc_id").alias("doc_id"))


def candidate_records(judged: DataFrame, features: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """One record for labelling of each candidate in features(), whatever its decision: its place, score, numbers and the line around it."""
    place = ["doc_id", "line_no", "start"]
    numbers = features.select("doc_id", "line_no", F.col("span_start").alias("start"), F.struct(*[c for c in features.columns if c not in ("doc_id", "line_no", "span_start")]).alias("features"))
    rows = with_line(judged.select(*place, "end", "text", "key", "score", "decision"), docs, text).join(numbers, place)
    return rows.select(*place, "text", "key", "score", "decision", "features", line_around(F.col("line"), F.col("start")).alias("context"))


def review_records(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Of candidate_records(), the first mention of each person under review; a person whose first mention has no features gives none."""
    level = F.max(F.when(F.col("decision") == "accepted", 2).when(F.col("decision") == "review", 1).otherwise(0))
    first = judged.groupBy("doc_id", "key").agg(level.alias("level"), F.min(F.struct("line_no", "start")).alias("at")).where("level = 1")
    return records.join(first.select("doc_id", "key", "at.*"), ["doc_id", "key", "line_no", "start"], "left_semi")


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum, in the order of a hash of the key. The window keeps n rows a task before it shuffles."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def balance(rows: DataFrame, label: Column, least: int = 10, ratio: int = 3) -> DataFrame:
    """One row: class sizes, and whether they allow training."""
    counts = rows.agg(F.count_if(label == 1).alias("positive"), F.count_if(label == 0).alias("negative"))
    low, high = F.least("positive", "negative"), F.greatest("positive", "negative")
    return counts.withColumn("trainable", (low >= least) & (high <= ratio * low))


def privacy_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind): which kinds of private data a text has, never the text."""
    kinds = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in PRIVATE.items()]), lambda k: k.isNotNull())
    return docs.select("doc_id", F.explode(kinds).alias("kind"))


def labelled(spans: DataFrame, gold: DataFrame) -> DataFrame:
    """spans with label 1 where they overlap a gold span, else 0; spans start once in a line."""
    hit = with_overlap(spans, gold).select("doc_id", "line_no", "start", F.lit(1).alias("label"))
    return spans.join(hit, ["doc_id", "line_no", "start"], "left").fillna(0, ["label"])


def weighted(rows: DataFrame, confirmed: Column, times: int = 3) -> DataFrame:
    """Adds copy: confirmed rows come several times, the others once."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(confirmed, times).otherwise(1))))


def without_sources(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't held out for evaluation."""
    return rows.join(held.select(key).distinct(), key, "left_anti")


def first_name_gold(gold: DataFrame, words: DataFrame) -> DataFrame:
    """Every other place in its document of the first word of a gold name of several words."""
    first = gold.where("instr(text, ' ') > 0").select("doc_id", F.split("text", " ")[0].alias("tok")).distinct()
    found = words.join(first, ["doc_id", "tok"]).select("doc_id", "line_no", "start", "end", F.col("tok").alias("text"))
    return without_overlap(found, gold)
