"""Span metrics: spans are grouped by line, or joined on document and line with a range residual."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .lexicon import has


def _overlap(a: str, b: str):
    same = (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.line_no") == F.col(f"{b}.line_no"))
    return same & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def without_overlap(spans: DataFrame, others: DataFrame) -> DataFrame:
    return spans.alias("a").join(others.alias("b"), _overlap("a", "b"), "left_anti")


def with_overlap(spans: DataFrame, others: DataFrame) -> DataFrame:
    return spans.alias("a").join(others.alias("b"), _overlap("a", "b"), "left_semi")


def _by_line(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, line_no, gs, ps): gold and predicted spans of each line that has any, in order. Both come in one shuffle."""
    tagged = lambda df, kind: df.select("doc_id", "line_no", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(kind).alias("kind"))
    own = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "end"))))
    return tagged(gold, "g").unionByName(tagged(predicted, "p")).groupBy("doc_id", "line_no").agg(own("g").alias("gs"), own("p").alias("ps"))


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def metrics(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: counts by any overlap, precision, recall and F1 rounded half to even."""
    return _rates(_by_line(predicted, gold).groupBy())


def domain_metrics(predicted: DataFrame, gold: DataFrame, domains: DataFrame) -> DataFrame:
    """metrics() of each domain; domains: (doc_id, domain), one row a document; documents that it lacks are uncategorized."""
    rows = _by_line(predicted, gold).join(domains.select("doc_id", "domain"), "doc_id", "left")
    return _rates(rows.groupBy(F.coalesce("domain", F.lit("uncategorized")).alias("domain")), "domain")


def _rates(groups: GroupedData, *keys: str) -> DataFrame:
    met = lambda xs, ys: F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: _meets(x, y))))
    counts = {"tp": met("ps", "gs"), "n_predicted": F.size("ps"), "gold_found": met("gs", "ps"), "n_gold": F.size("gs")}
    sums = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in counts.items()])
    p, r = F.try_divide("tp", "n_predicted"), F.try_divide("gold_found", "n_gold")
    return sums.select(*keys, *counts, F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(F.try_divide(2 * p * r, p + r), 4).alias("f1"))


def by_size(text: Column) -> Column:
    return F.when(text.contains(" "), "multi").otherwise("single")


def by_dictionary(text: Column) -> Column:
    return F.when(F.exists(F.split(F.lower(text), " "), lambda w: has(w, "first") | has(w, "last")), "dictionary_known").otherwise("unseen")


def shape_recall(gold: DataFrame, predicted: DataFrame, shape: Callable[[Column], Column] = by_size) -> DataFrame:
    """Recall by shape: single or multi word, or another that is told of a mention's text."""
    hit = with_overlap(gold, predicted).select("doc_id", "line_no", "start", F.lit(1).alias("hit"))
    return gold.join(hit, ["doc_id", "line_no", "start"], "left").groupBy(shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_found"))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(transition, n) of two tables (name, decision)."""
    b, a = before.select("name", F.col("decision").alias("b")), after.select("name", F.col("decision").alias("a"))
    change = F.concat(F.coalesce("b", F.lit("absent")), F.lit("->"), F.coalesce("a", F.lit("absent")))
    return b.join(a, "name", "full").groupBy(change.alias("transition")).agg(F.count("*").alias("n"))


def one_to_one(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_gold, n_predicted, n_matched): in order, each gold span takes the first overlapping prediction still free.

    A fold over the spans of one line; spans of two lines never overlap.
    """
    rows = _by_line(predicted, gold)

    def take(used, g):
        places = F.sequence(F.lit(0), F.greatest(F.size("ps") - 1, F.lit(0)))
        free = F.filter(places, lambda i: F.coalesce(_meets(F.get("ps", i), g), F.lit(False)) & ~F.array_contains(used, i))
        return F.concat(used, F.slice(free, 1, 1))

    used = F.aggregate("gs", F.array().cast("array<int>"), take)
    return rows.select("doc_id", "line_no", F.size("gs").alias("n_gold"), F.size("ps").alias("n_predicted"), F.size(used).alias("n_matched"))


def promotion_gate(before: DataFrame, after: DataFrame, metrics_before: DataFrame, metrics_after: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row (worst_drop, f1_gain, promote) of two tables of shape_recall() and of metrics(): no shape may lose more than the tolerance, unless F1 doesn't fall."""
    recall = lambda df, one, name: df.select("shape", F.try_divide("n_found", "n_gold").alias(name)).unionByName(one.select(F.lit("f1").alias("shape"), F.col("f1").alias(name)))
    rows = recall(before, metrics_before, "b").join(recall(after, metrics_after, "a"), "shape", "full").select("shape", F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("a", F.lit(0.0)).alias("a"))
    drop, gain = F.max(F.when(F.col("shape") != "f1", F.col("b") - F.col("a"))), F.max(F.when(F.col("shape") == "f1", F.col("a") - F.col("b")))
    return rows.agg(F.bround(drop, 4).alias("worst_drop"), F.bround(gain, 4).alias("f1_gain"), ((drop <= tolerance) | (gain >= 0)).alias("promote"))


def what_if(scored: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """scored: (name, decision, p). (scenario, threshold, n_accepted): accepted names cleaned up, review names promoted, or both."""
    rows = scored.select("decision", "p", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), F.explode(F.array(*map(F.lit, ("cleanup", "promote", "both")))).alias("scenario"))
    sure = F.col("p") >= F.col("threshold")
    kept = (F.col("decision") == "accepted") & ((F.col("scenario") == "promote") | sure)
    risen = (F.col("decision") == "review") & (F.col("scenario") != "cleanup") & sure
    return rows.groupBy("scenario", "threshold").agg(F.count_if(kept | risen).alias("n_accepted"))


def medians(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """(stage, n, median) of the values that aren't null: the middle one, or half the sum of the two."""
    w = Window.partitionBy(stage)
    ranked = rows.where(F.col(value).isNotNull()).select(stage, F.col(value).cast("double").alias("value"), F.row_number().over(w.orderBy(value)).alias("k"), F.count("*").over(w).alias("n"))
    middle = ranked.where("2 * k between n and n + 2").groupBy(stage, "n").agg(F.min(F.when(F.col("k") == F.floor((F.col("n") + 1) / 2), F.col("value"))).alias("low"), F.min(F.when(F.col("k") == F.floor((F.col("n") + 2) / 2), F.col("value"))).alias("high"))
    return middle.select(stage, "n", ((F.col("low") + F.col("high")) / 2).alias("median"))
