"""Span detectors: texts to rows (doc_id, line_no, start, end, text, pattern, confidence).

Lines are exploded first and never joined again: offsets are code points within the line, so that nothing is shuffled
for them. A line is cut at its capitalised words by one pattern; the words' places follow from the lengths of what lies between.
Runs of words then live in an array of the row, which higher-order functions fold from left to right.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import has, name_key

WORD = r"(?<![\p{L}_'\-])\p{Lu}[\p{L}_'\-]*"
CONFIDENCE = {"titled": "0.90", "bare": "0.55", "dictionary": "0.85", "dictionary_single_token": "0.40", "document_name": "0.60", "model": "0.50"}
BLANKS = r"^[ \t]{1,2}$"
AFTER_POINT = r"^\.[ \t]{1,2}$"


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no from 1, line)."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def places(found: Column, between: Column) -> Column:
    """array<struct<start, end, tok, gap>> of a pattern's matches and what lies between them; gap is what follows up to the next.

    Both must be columns: expressions would be worked out again for each match.
    """
    length = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    at = lambda i: length(between, i + 1) + length(found, i)
    return F.transform(found, lambda tok, i: F.struct(at(i).alias("start"), (at(i) + F.length(tok)).alias("end"), tok.alias("tok"), F.element_at(between, i + 2).alias("gap")))


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, ix, start, end, tok, key, linked, spaced): capitalised words; key is what names are looked up by.

    A word is linked if it belongs to the word before it, and spaced if only one or two blanks follow up to the next.
    """
    rows = lines(docs, text).where(F.col("line").rlike(r"\p{Lu}")).select("doc_id", "line_no", F.regexp_extract_all("line", F.lit(WORD), 0).alias("found"), F.split("line", WORD, -1).alias("between"))
    rows = rows.select("doc_id", "line_no", places(F.col("found"), F.col("between")).alias("ws"))
    before = lambda ws, i: F.get(ws, i - 1)
    joins = lambda w: w["gap"].rlike(BLANKS) | (w["gap"].rlike(AFTER_POINT) & ((F.length(w["tok"]) == 1) | has(F.lower(w["tok"]), "title")))
    marked = F.transform("ws", lambda w, i: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["tok"].alias("tok"), name_key(F.lower(w["tok"])).alias("key"), F.coalesce(joins(before(F.col("ws"), i)), F.lit(False)).alias("linked"), w["gap"].rlike(BLANKS).alias("spaced")))
    return rows.select("doc_id", "line_no", F.posexplode(marked).alias("ix", "w")).select("doc_id", "line_no", "ix", "w.*")


def _runs(ws: DataFrame) -> DataFrame:
    """(doc_id, line_no, run, ws array): linked words; a title after a name begins a new run."""
    by = "partition by doc_id, line_no order by ix"
    title = has(F.col("key"), "title")
    cut = ws.withColumn("t", title).withColumn("new", F.expr(f"not linked or (t and not coalesce(lag(t) over ({by}), true))").cast("int"))
    return cut.withColumn("run", F.expr(f"sum(new) over ({by})")).groupBy("doc_id", "line_no", "run").agg(F.array_sort(F.collect_list(F.struct("ix", "start", "end", "tok", "key", "t"))).alias("ws"))


def _found(parts: Column, pattern: str) -> Column:
    """array<array of words> to array<struct<part, pattern>>."""
    return F.transform(parts, lambda p: F.struct(p.alias("part"), F.lit(pattern).alias("pattern")))


def _titled() -> Column:
    names = F.slice(F.filter("ws", lambda w: ~w["t"]), 1, 4)
    return F.filter(_found(F.array(names), "titled"), lambda f: F.col("ws")[0]["t"] & (F.size(f["part"]) > 0))


def _bare() -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.expr("(size(ws) - 1) div 4")), lambda k: F.slice("ws", k * 4 + 1, 4))
    return F.filter(_found(parts, "bare"), lambda f: ~F.col("ws")[0]["t"] & (F.size(f["part"]) > 1))


def _take(ws: Column) -> Column:
    """Left to right: two words that fill distinct roles, with a third that is a known last name; else a known word alone."""
    first, last = lambda w: has(w["key"], "first"), lambda w: has(w["key"], "last")
    pair = lambda a, b: (first(a) & last(b)) | (last(a) & first(b))
    kind = "struct<next:int,found:array<struct<at:int,n:int>>>"

    def step(state, i):
        a, b, c = F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)
        two = F.coalesce(pair(a, b), F.lit(False))
        n = F.when(two & F.coalesce(last(c), F.lit(False)), 3).when(two, 2).when(first(a) | last(a), 1).otherwise(0)
        taken = F.struct((i + F.greatest(n, F.lit(1))).alias("next"), F.when(n > 0, F.concat(state["found"], F.array(F.struct(i.alias("at"), n.alias("n"))))).otherwise(state["found"]).alias("found"))
        return F.when(i < state["next"], state).otherwise(taken).cast(kind)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,n:int>>").alias("found")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0))), start, step, lambda s: s["found"])


def _dictionary() -> Column:
    names = F.filter("ws", lambda w: ~w["t"])
    some = F.exists("ws", lambda w: ~w["t"] & (has(w["key"], "first") | has(w["key"], "last")))
    taken = F.when(some, _take(names)).otherwise(F.array().cast("array<struct<at:int,n:int>>"))
    return F.transform(taken, lambda f: F.struct(F.slice(names, f["at"] + 1, f["n"]).alias("part"), F.when(f["n"] > 1, "dictionary").otherwise("dictionary_single_token").alias("pattern")))


def _spans(docs: DataFrame, text: str, found: Column) -> DataFrame:
    """The spans that found names in each run of words; the text is read, cut and shuffled once whatever found asks for."""
    rows = _runs(words(docs, text)).select("doc_id", "line_no", F.inline(found))
    confidence = F.coalesce(*[F.when(F.col("pattern") == k, F.lit(v)) for k, v in CONFIDENCE.items()]).cast("decimal(6,4)")
    return rows.select("doc_id", "line_no", F.col("part")[0]["start"].alias("start"), F.element_at("part", -1)["end"].alias("end"), F.concat_ws(" ", F.col("part.tok")).alias("text"), "pattern", confidence.alias("confidence"))


def titled_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """One to four name words after one or more titles."""
    return _spans(docs, text, _titled())


def bare_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two to four linked capitalised words; what a title leads is the titled detector's."""
    return _spans(docs, text, _bare())


def dictionary_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Windows of two or three known names, and the known names that are left."""
    return _spans(docs, text, _dictionary())


def model_spans(docs: DataFrame, load: Callable[[], Callable[[str], list[tuple[int, int]]]], text: str = "text") -> DataFrame:
    """Spans that a model finds in each line. load() is called once a task and gives a function of a line to places (start, end).

    Words with digits aren't part of a name, and part its pieces. A line that the model fails on has no spans.
    """

    def run(batches):
        find = load()
        for b in batches:
            for doc, line_no, line in zip(b["doc_id"], b["line_no"], b["line"]):
                try:
                    places = find(line)
                except Exception as e:  # one line's failure is no reason to lose the others
                    warnings.warn(f"no spans of line {line_no} of {doc}: {e}", stacklevel=2)
                    continue
                pieces = [(s + m.start(), m.group()) for s, e in places for m in re.finditer(r"[^\s\d]+(?:\s+(?!\S*\d)\S+)*", re.sub(r"\S*\d\S*", lambda d: "0" * len(d.group()), line[s:e]))]
                if pieces:
                    yield pd.DataFrame([(doc, line_no, at, at + len(p), " ".join(p.split())) for at, p in pieces], columns=["doc_id", "line_no", "start", "end", "text"])

    rows = lines(docs, text).where(F.col("line").rlike(r"\p{Lu}"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInPandas(run, f"doc_id {kind}, line_no int, start int, end int, text string")
    return found.select("*", F.lit("model").alias("pattern"), F.lit(CONFIDENCE["model"]).cast("decimal(6,4)").alias("confidence"))


def detections(docs: DataFrame, text: str = "text", more: Sequence[Callable[[DataFrame, str], DataFrame]] = ()) -> DataFrame:
    """All detectors in one pass, and the spans of more detectors, of the same columns; these may have patterns of their own."""
    found = _spans(docs, text, F.concat(_titled(), _bare(), _dictionary()))
    for detector in more:
        found = found.unionByName(detector(docs, text))
    return found
