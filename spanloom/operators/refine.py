"""What follows the first decision: boundaries, features, propagated first names and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candidates import decide, dominance, rank
from .context import cue_features, with_line
from .detect import CONFIDENCE
from .lexicon import has


def _known(w: Column) -> Column:
    return has(w, "first") | has(w, "last")


def split_names(name: Column) -> Column:
    """array<string>: two names where four words hold two dictionary pairs, told loosely: both words of a half are known."""
    ws = F.split(name, " ")
    half = lambda a: _known(F.lower(F.get(ws, F.lit(a)))) & _known(F.lower(F.get(ws, F.lit(a + 1))))
    two = F.array(F.concat_ws(" ", F.slice(ws, 1, 2)), F.concat_ws(" ", F.slice(ws, 3, 2)))
    return F.when((F.size(ws) == 4) & (half(0) | half(2)), two).otherwise(F.array(name))


def rescue_edge(name: Column) -> Column:
    """Of two words, one an organisation's and the other a known name, the name stays."""
    ws = F.split(name, " ")
    a, b = F.get(ws, F.lit(0)), F.get(ws, F.lit(1))
    org = lambda w: has(F.lower(w), "organization")
    return F.when((F.size(ws) == 2) & org(a) & ~org(b) & _known(F.lower(b)), b).when((F.size(ws) == 2) & org(b) & ~org(a) & _known(F.lower(a)), a).otherwise(name)


def features(judged: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Numbers of each candidate that no rule rejects: of its text (titles aside where words are judged), its detectors and its line."""
    ws = F.split("key", " ")
    n = F.size(ws)
    plain = F.filter(F.transform(ws, lambda w: F.regexp_replace(w, "[.'’]+$", "")), lambda w: w != "")
    untitled = F.filter(plain, lambda w: ~has(w, "title") & ~has(w, "honorific"))
    body = F.when(F.size(untitled) > 0, untitled).otherwise(plain)
    within = lambda test: F.size(F.filter(body, test))
    best = lambda *ps: F.coalesce(*[F.when(F.array_contains("patterns", p), F.lit(float(CONFIDENCE[p]))) for p in ps], F.lit(0.0))
    by_rule, by_list = best("titled", "bare"), best("dictionary", "dictionary_single_token")
    flag = lambda p: F.array_contains("patterns", p).cast("int")
    count = lambda test: F.size(F.filter(ws, test))
    return with_line(judged.where("failed is null"), docs, text).select(
        "doc_id", "line_no", F.col("start").alias("span_start"), n.alias("token_count"), F.length("text").alias("char_length"),
        count(lambda w: F.length(w) == 1).alias("initials"), count(lambda w: has(w, "first")).alias("known_first"), count(lambda w: has(w, "last")).alias("known_last"),
        F.coalesce(F.bround(F.try_divide(within(lambda w: has(w, "common")), F.size(body)), 4), F.lit(0.0)).alias("common_share"), F.coalesce(has(F.get(body, F.lit(0)), "ambiguous").cast("int"), F.lit(0)).alias("first_ambiguous"),
        within(lambda w: has(w, "location") | has(w, "organization")).alias("place_or_org"), flag("titled").alias("titled"), flag("dictionary").alias("dictionary"), flag("bare").alias("bare"), "n_detections", "reps",
        F.bround((count(lambda w: has(w, "first")) + count(lambda w: has(w, "last"))) / n, 4).alias("known_share"), (count(lambda w: has(w, "honorific")) > 0).cast("int").alias("honorific"),
        F.bround(F.size(F.filter(F.split("text", " "), lambda w: w.rlike(r"^\p{Lu}"))) / n, 4).alias("capital_share"), by_rule.alias("rule_confidence"), by_list.alias("list_confidence"),
        ((by_rule > 0).cast("int") + (by_list > 0).cast("int")).alias("n_detectors"), *[v.alias(k) for k, v in cue_features(F.col("prefix"), F.col("suffix")).items()],
    )


def _vouches() -> Column:
    """Whether a row is an accepted full name whose first word may stand for the person."""
    first = F.split("text", " ")[0]
    barred = [has(F.lower(first), x) for x in ("common", "ambiguous", "calendar", "language")]
    return (F.col("decision") == "accepted") & (F.instr("text", " ") > 0) & (F.length(first) >= 2) & ~barred[0] & ~barred[1] & ~barred[2] & ~barred[3]


def _any_with(flag: Column, word: Column) -> Column:
    """Whether flag holds for some row of the document with the same word; a window, so that the rows aren't worked out twice for a join."""
    return F.coalesce(F.max(flag.cast("int")).over(Window.partitionBy("doc_id", word)) == 1, F.lit(False))


def propagatable(judged: DataFrame) -> DataFrame:
    """(doc_id, tok): first words of accepted full names that may stand for the person."""
    return judged.where(_vouches()).select("doc_id", F.split("text", " ")[0].alias("tok")).distinct()


def undetected(words: DataFrame, judged: DataFrame, cands: DataFrame) -> DataFrame:
    """Words of a document that are a propagatable name, exactly, overlap no candidate and don't stand one or two blanks before one."""
    found = words.join(propagatable(judged), ["doc_id", "tok"]).select("doc_id", "line_no", "start", "end", F.col("tok").alias("text"), "spaced")
    a, b = found.alias("a"), cands.select("doc_id", "line_no", "start", "end").alias("b")
    same, before = F.expr("a.doc_id = b.doc_id and a.line_no = b.line_no"), F.expr("a.spaced and b.start between a.end + 1 and a.end + 2")
    return a.join(b, same & (F.expr("a.start < b.end and b.start < a.end") | before), "left_anti").drop("spaced")


def propagated(judged: DataFrame, words: DataFrame, cands: DataFrame) -> DataFrame:
    """The undetected() mentions as candidates, in the form of canonical(), with the evidence of the name that vouches for them."""
    evidence = F.lit(CONFIDENCE["document_name"]).cast("decimal(16,4)")
    spans = undetected(words, judged, cands).select("doc_id", "line_no", "start", "end", "text")
    return spans.withColumns({"evidence": evidence, "patterns": F.array(F.lit("document_name")), "n_detections": F.lit(1).cast("long")})


def capped(judged: DataFrame) -> DataFrame:
    """Accepted single words that are common and a last name only go to review, unless an accepted full name has them at an edge."""
    single = (F.col("decision") == "accepted") & (F.instr("text", " ") == 0) & has(F.col("key"), "common") & has(F.col("key"), "last") & ~has(F.col("key"), "first") & ~F.arrays_overlap("patterns", F.array(F.lit("titled"), F.lit("document_name")))
    full = (F.col("decision") == "accepted") & (F.instr("text", " ") > 0)
    edge = _any_with(full, F.element_at(F.split("key", " "), 1)) | _any_with(full, F.element_at(F.split("key", " "), -1))
    rows = judged.withColumn("edge", edge)
    return rows.withColumn("decision", F.when(single & ~F.col("edge"), "review").otherwise(F.col("decision"))).drop("edge")


def strongest(patterns: Column) -> Column:
    """The pattern of highest priority."""
    return F.array_min(F.transform(patterns, lambda p: F.struct(rank(p).alias("r"), p.alias("p"))))["p"]


def promoted(judged: DataFrame) -> DataFrame:
    """Lone words under review that are the first word of an accepted full name of their document are decided anew with its evidence."""
    rows = judged.withColumn("vouched", _any_with(_vouches(), F.split("key", " ")[0]))
    lone = F.col("vouched") & (F.col("decision") == "review") & (F.instr("text", " ") == 0)
    score = F.when(lone, F.col("score") + F.lit("0.60").cast("decimal(6,4)")).otherwise(F.col("score")).cast("decimal(8,4)")
    rows = rows.withColumn("score", score)
    return rows.withColumn("decision", F.when(lone, decide(F.col("score"), F.lit(True), F.lit(False))).otherwise(F.col("decision"))).drop("vouched")


def lone_capped(judged: DataFrame, flagged: DataFrame) -> DataFrame:
    """Accepted single words without a title go to review in the documents (doc_id) that are structured or short and no prose."""
    rows = judged.join(flagged.select("doc_id").distinct().withColumn("flagged", F.lit(True)), "doc_id", "left")
    lone = F.col("flagged") & (F.col("decision") == "accepted") & (F.instr("text", " ") == 0) & ~F.arrays_overlap("patterns", F.array(F.lit("titled"), F.lit("document_name")))
    return rows.withColumn("decision", F.when(lone, "review").otherwise(F.col("decision"))).drop("flagged")


def merged_collection(names: DataFrame) -> DataFrame:
    """collection() with longer names counted as the shorter name that dominates them; one pass, no chains."""
    core = dominance(names.select("name", F.col("total_occurrences").alias("n"))).select("name", F.coalesce("core", "name").alias("core"))
    return names.join(core, "name").groupBy(F.col("core").alias("name")).agg(F.sum("total_occurrences").alias("total_occurrences"), F.min("decision").alias("decision"), F.count("*").alias("n_forms"))
