"""Rows of the exports, ready for a writer: persons, documents as JSON or text, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def person_rows(judged: DataFrame) -> DataFrame:
    """(doc_id, person_name, occurrences, decision, best_score, locations, why): accepted and review persons; why is of the best mention."""
    level = F.when(F.col("decision") == "accepted", 2).when(F.col("decision") == "review", 1).otherwise(0)
    place = F.struct("line_no", "start")
    first = F.struct("score", -F.col("line_no"), -F.col("start"))
    rows = judged.groupBy("doc_id", "key").agg(
        F.count("*").alias("occurrences"), F.max(level).alias("level"), F.max("score").cast("double").alias("best_score"),
        F.array_sort(F.collect_list(place)).alias("at"), F.max_by(F.concat_ws(", ", "patterns"), first).alias("why"), F.min_by("text", place).alias("person_name"),
    )
    spots = F.transform("at", lambda a: F.concat(F.lit("line "), a["line_no"], F.lit(", col "), a["start"] + 1))
    decision = F.when(F.col("level") == 2, "accepted").otherwise("review")
    return rows.where("level > 0").select("doc_id", "person_name", "occurrences", decision.alias("decision"), "best_score", F.array_join(spots, "; ").alias("locations"), "why")


def document_json(people: DataFrame) -> DataFrame:
    """(doc_id, json): the names of each decision, from persons()."""
    names = lambda d: F.array_sort(F.collect_list(F.when(F.col("decision") == d, F.struct(F.col("display").alias("name"), "occurrences"))))
    rows = people.groupBy("doc_id").agg(*[names(d).alias(d) for d in ("accepted", "review", "rejected")])
    return rows.select("doc_id", F.to_json(F.struct("doc_id", "accepted", "review", "rejected")).alias("json"))


def document_report(people: DataFrame) -> DataFrame:
    """(doc_id, report): a heading for each decision, and its names below."""
    entry = F.concat(F.lit("  "), F.col("display"), F.lit(" x"), F.col("occurrences"))
    block = lambda d: F.array_sort(F.collect_list(F.when(F.col("decision") == d, entry)))
    rows = people.groupBy("doc_id").agg(block("accepted").alias("a"), block("review").alias("r"))
    head = lambda name, c: F.concat(F.lit(name + ": "), F.size(c).cast("string"))
    return rows.select("doc_id", F.array_join(F.concat(F.array(head("accepted", F.col("a"))), F.col("a"), F.array(head("review", F.col("r"))), F.col("r")), "\n").alias("report"))


def scan_rows(files: DataFrame, people: DataFrame) -> DataFrame:
    """(doc_id, status, num_names, names) of files (doc_id, status): names are the accepted ones of the files read."""
    named = people.where("decision = 'accepted'").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("display")), "; ").alias("names"))
    ok = F.col("status") == "ok"
    return files.join(named, "doc_id", "left").select("doc_id", "status", F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).alias("num_names"), F.when(ok, F.coalesce("names", F.lit(""))).otherwise("").alias("names"))


def scan_metrics(scan: DataFrame) -> DataFrame:
    """(metric, value): counts of scan_rows() and the share of files read, in per cent."""
    ok = F.count_if(F.col("status") == "ok")
    one = scan.agg(F.count("*").cast("double").alias("files"), ok.cast("double").alias("ok"), F.coalesce(F.sum("num_names"), F.lit(0)).cast("double").alias("names"), F.bround(100 * ok / F.count("*"), 2).alias("coverage_percent"))
    return one.unpivot([], ["files", "ok", "names", "coverage_percent"], "metric", "value")
