"""Candidates: overlapping spans merged, the best span chosen, judged by rules, scored and decided."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import has, keys, name_key

PLACE = ("doc_id", "line_no")
ACCEPT, REVIEW = "0.75", "0.45"
#: Validators in order; the first that fails rejects.
ORDER = ("length", "structure", "punctuation", "repetition", "initial", "language", "corroboration", "blacklist", "campaign", "organization", "location", "stopword")


def overlap_groups(spans: DataFrame) -> DataFrame:
    """Adds grp: spans of a line that overlap share it; spans that only touch don't."""
    w = Window.partitionBy(*PLACE).orderBy("start", F.desc("end"), "pattern")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def rank(pattern: Column) -> Column:
    return F.when(pattern == "titled", 0).when(pattern == "dictionary", 1).when(pattern == "dictionary_single_token", 2).otherwise(3)


def plausible(key: Column) -> Column:
    """Whether a word beside a known name may belong to it."""
    barred = [has(key, x) for x in ("ambiguous", "calendar", "stopword", "location", "organization", "language")]
    refused = barred[0]
    for other in barred[1:]:
        refused = refused | other
    return (F.length(key) >= 2) & ~refused & (has(key, "first") | has(key, "last") | ~has(key, "common"))


def middle_initial(name: Column) -> Column:
    """A word, one or more initials, a word."""
    return name.rlike(r"^\S{2,}(?: \p{Lu})+ \S{2,}$")


def _wider(best: Column, spans: Column) -> Column:
    """The first bare span around a lone known name, of two words whose other one is plausible, or with middle initials."""
    words = lambda s: F.split(F.lower(s["text"]), " ")
    others = lambda s: F.filter(words(s), lambda w: w != F.lower(best["text"]))
    fits = lambda s: middle_initial(s["text"]) | ((F.size(words(s)) == 2) & F.forall(others(s), plausible))
    return F.get(F.filter(spans, lambda s: (s["start"] <= best["start"]) & (s["end"] >= best["end"]) & fits(s)), F.lit(0))


def canonical(groups: DataFrame) -> DataFrame:
    """One row for each group: the best pattern's widest span, with the evidence of all; a lone known name may be widened."""
    order = F.struct(-rank(F.col("pattern")), F.col("end") - F.col("start"), -F.col("start"))
    span = F.struct("start", "end", "text")
    rows = groups.groupBy(*PLACE, "grp").agg(
        F.max_by(F.struct("start", "end", "text", "pattern"), order).alias("best"), F.sum("confidence").alias("evidence"),
        F.array_sort(F.collect_set("pattern")).alias("patterns"), F.count("*").alias("n_detections"),
        F.array_sort(F.collect_list(F.when(F.col("pattern") == "bare", span))).alias("bares"),
    )
    lone = F.col("best.pattern") == "dictionary_single_token"
    plain = F.struct("best.start", "best.end", "best.text")
    one = F.coalesce(F.when(lone, _wider(F.col("best"), F.col("bares"))), plain)
    return rows.withColumn("one", one).select(*PLACE, "one.*", "evidence", "patterns", "n_detections")


def trim_stopwords(name: Column) -> Column:
    """Drops leading, then trailing stopwords, four at most, and keeps a word."""
    edge = "|".join(map(re.escape, keys("stopword")))
    name = F.regexp_replace(name, f"(?i)^(?:(?:{edge}) ){{1,4}}(?=\\S)", "")
    return F.regexp_replace(name, f"(?i)(?<=\\S)(?: (?:{edge})){{1,4}}$", "")


def dominance(counts: DataFrame) -> DataFrame:
    """counts: (name, n). Adds core: the name without its first or last word where that is three times as frequent."""
    core = counts.select(F.col("name").alias("core"), F.col("n").alias("core_n")).where("core_n >= 3 and instr(core, ' ') > 0")
    cut = counts.select("name", "n", F.explode(F.array(F.regexp_replace("name", "^\\S+ ", ""), F.regexp_replace("name", " \\S+$", ""))).alias("core"))
    found = cut.where("core <> name").join(core, "core").where("core_n >= 3 * n").groupBy("name").agg(F.max_by("core", F.struct("core_n", "core")).alias("core"))
    return counts.join(found, "name", "left")


def repetitions(cands: DataFrame) -> DataFrame:
    """(doc_id, key, reps): how often each name is a candidate of its document."""
    return cands.groupBy("doc_id", F.lower("text").alias("key")).agg(F.count("*").alias("reps"))


def occurrences(cands: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, occurrences): how often each candidate's text is in its whole document, as words of their own; one count a distinct text."""
    names = cands.groupBy("doc_id").agg(F.collect_set("text").alias("names"))
    alone = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), n, F.lit(r"\E(?![\p{L}\p{N}_])"))
    counts = F.transform("names", lambda n: F.struct(n.alias("text"), F.regexp_count(F.col("__whole"), alone(n)).alias("occurrences")))
    return docs.select("doc_id", F.col(text).alias("__whole")).join(names, "doc_id").select("doc_id", F.inline(counts))


def is_sure(patterns: Column, reps: Column) -> Column:
    """Whether knowledge backs a name: a title, a dictionary pair, or a known word found four times."""
    strong = F.arrays_overlap(patterns, F.array(F.lit("titled"), F.lit("dictionary"), F.lit("document_name")))
    return strong | (F.array_contains(patterns, "dictionary_single_token") & (reps >= 4))


def all_common(key: Column) -> Column:
    return F.forall(F.split(key, " "), lambda w: has(w, "common"))


def decide(score: Column, sure: Column, common: Column) -> Column:
    reached = lambda least: score >= F.lit(least).cast("decimal(4,2)")
    return F.when(reached(ACCEPT) & sure, "accepted").when(reached(REVIEW) & ~(~sure & common), "review").otherwise("rejected")


def judged(cands: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Adds reps, failed (the first validator that rejects), score and decision. All rules are expressions over one row.

    reps is how often a name is a candidate of its document, or more where counts, of occurrences(), finds it more often.
    """
    rows = cands.withColumn("key", F.lower("text")).withColumn("reps", F.count("*").over(Window.partitionBy("doc_id", "key")))
    if counts is not None:
        rows = rows.join(counts, ["doc_id", "text"], "left").withColumn("reps", F.greatest("reps", F.col("occurrences").cast("long"))).drop("occurrences")
    rows = rows.withColumn("ws", F.split("key", " ")).withColumn("raw", F.split("text", " "))
    n = F.size("ws")
    rows = rows.withColumn("looked_up", F.transform("ws", name_key))
    known = F.size(F.filter("looked_up", lambda w: has(w, "first") | has(w, "last")))
    # all runs of words, the whole name among them; names of over five words fail by their length before
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("ws", i, k)))).otherwise(F.array().cast("array<string>"))
    pairs = F.concat("ws", *[runs(k) for k in range(2, 6)])
    strong = F.arrays_overlap("patterns", F.array(F.lit("titled"), F.lit("dictionary"), F.lit("document_name")))
    single = F.array_contains("patterns", "dictionary_single_token") & ~(has(F.col("ws")[0], "ambiguous") | ((n == 1) & has(F.col("key"), "calendar")))
    fails = {
        "length": (F.length("text") < 3) | (F.length("text") > 60) | (n > 5),
        "structure": F.exists("raw", lambda w: ~w.rlike(r"^\p{Lu}[\p{L}'\-]*\.?$") | (w.rlike(r"^\p{Lu}{2,}s?$") & ~has(F.lower(w), "last"))),
        "punctuation": F.col("text").rlike(r"[0-9!@#$%^&*()_+=\[\]{}<>/|~`\\]"),
        "repetition": F.size(F.array_distinct("ws")) < n,
        "initial": F.forall("raw", lambda w: F.length(w) == 1),
        "language": F.col("text").rlike(r"(?:(?!\p{IsLatin})\p{L})") | F.exists("ws", lambda w: has(w, "marker")),
        "campaign": F.exists(pairs, lambda p: has(p, "campaign")) | F.exists("ws", lambda w: has(w, "slogan")),
        "corroboration": ~(strong | single | ((F.col("reps") >= 4) & ~((n == 1) & has(F.col("key"), "calendar")))),
        "blacklist": F.exists(pairs, lambda p: has(p, "blacklist")),
        "organization": F.exists("ws", lambda w: has(w, "organization")),
        "location": F.exists(pairs, lambda p: has(p, "location")) & ~(F.exists("looked_up", lambda w: has(w, "first") & ~has(w, "location")) | ((n > 1) & (F.col("reps") >= 4))),
        "stopword": F.exists("ws", lambda w: has(w, "stopword")),
    }
    rows = rows.withColumn("failed", F.coalesce(*[F.when(fails[k], F.lit(k)) for k in ORDER]))
    ratio = F.when(known * 4 == n, 0.17).when(known * 4 == n * 3, 0.52).otherwise(F.round(known * F.lit("0.7").cast("decimal(4,2)") / n, 2)).cast("decimal(6,4)")
    title = F.when(F.array_contains("patterns", "titled"), F.lit("0.30")).otherwise("0.00").cast("decimal(6,4)")
    initials = F.when(F.exists("raw", lambda w: F.length(w) == 1), F.lit("0.05")).otherwise("0.00").cast("decimal(6,4)")
    score = F.when(F.col("failed").isNotNull(), F.lit(0)).otherwise(F.col("evidence") + F.lit("0.20").cast("decimal(6,4)") + ratio + title + initials).cast("decimal(8,4)")
    rows = rows.withColumn("score", score)
    return rows.withColumn("decision", decide(F.col("score"), is_sure(F.col("patterns"), F.col("reps")), all_common(F.col("key")))).drop("ws", "raw", "looked_up")


def persons(cands: DataFrame) -> DataFrame:
    """(doc_id, key, display, occurrences, decision, best_score): the casing used most, the first of equals."""
    forms = cands.groupBy("doc_id", "key", "text").agg(
        F.count("*").alias("n"), F.min(F.struct("line_no", "start")).alias("at"), F.max("score").alias("best"),
        F.max(F.when(F.col("decision") == "accepted", 2).when(F.col("decision") == "review", 1).otherwise(0)).alias("level"),
    )
    first = F.struct(F.col("n"), -F.col("at.line_no"), -F.col("at.start"))
    level = F.max("level")
    return forms.groupBy("doc_id", "key").agg(F.max_by("text", first).alias("display"), F.sum("n").alias("occurrences"), F.element_at(F.array(F.lit("rejected"), F.lit("review"), F.lit("accepted")), level + 1).alias("decision"), F.max("best").alias("best_score"))


def collection(people: DataFrame) -> DataFrame:
    """(name, total_occurrences, decision, num_documents, first_document) over all documents, of accepted and review persons.

    The documents themselves are the rows of people, of which a frequent name has too many for one value.
    """
    rows = people.where("decision <> 'rejected'")
    return rows.groupBy(F.col("key").alias("name")).agg(
        F.sum("occurrences").alias("total_occurrences"), F.when(F.bool_or(F.col("decision") == "accepted"), "accepted").otherwise("review").alias("decision"),
        F.count("*").alias("num_documents"), F.min("doc_id").alias("first_document"),
    )
