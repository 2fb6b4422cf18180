"""Planted lines with known mentions, set between ** marks; documents get two of them each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKED = (
    "Yesterday Dr. **Anna Keller** met the board in Berlin.",
    "we saw **Maria Lopez** and **Peter Novak** at noon",
    "**John Smith Karl Young** signed; later **John** wrote.",
    "The Apache License applies. Old Stone Bridge fell on Monday.",
    "Prof. Dr. **Laura Stone**, doctor, called **David Smith**'s office",
    "Happy Birthday Anna! New York  is far from Paris Texas.",
    "J. **Karl Novak** came; USA and UK Ltd stayed",
    "**Stteen Erachtz** spoke with Bank Group of Jordan",
    "in April or August nobody called",
    "Mr. **Ümit Öztürk** and Mrs **Zoë Quill** left, **Ümit** and Anna Anna too.",
    "Orre Orre Orre Orre went to **Peter Keller**   Smith",
    "a plain line about Maria Stone Avenue, which is a street",
    "2024-01-05 10:11:12.345 1234 5678 I ActivityManager: Anna Keller started",
    "write to **Peter Novak** at www.novak.co.uk or anna@mail.office.ac.in today",
    "queued by android.os.Handler for Maria Lopez and David Smith",
    "-Uid 10294-Pkg com.example-POL Anna Lopez",
    "the doctor **Anna Smith** wrote; see http://Anna Keller and David Stone @work",
    "they Vote John Smith; Karl Und Keller; Клара Novak came. Clean City Laura Lopez",
    "\"He met **Quentin Keller** and **Peter Q Novak** there\" said a neighbour",
    "Then Sir **Karl Lopez** told **Maria** French wine is good, the **Anna Novak** insurance said",
)


def _pick(table: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, table)), (index % len(table) + 1).cast("int"))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, marked): the two planted lines of each document."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    two = F.array(F.struct((n + 1).alias("line_no"), _pick(MARKED, F.col("doc_id")).alias("marked")), F.struct((n + 2).alias("line_no"), _pick(MARKED, F.col("doc_id") * 7 + 3).alias("marked")))
    return docs.select("doc_id", F.inline(two))


def planted(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more): documents with their planted lines."""
    plain = tuple(m.replace("**", "") for m in MARKED)
    return docs.select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), _pick(plain, F.col("doc_id")), _pick(plain, F.col("doc_id") * 7 + 3)).alias("text"), *more)


def gold(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, text) of lines (doc_id, line_no, marked): mentions and their places once the marks are gone."""
    parts = F.split("marked", "\\*\\*", -1)
    before = lambda i: F.aggregate(F.slice(F.col("parts"), 1, i), F.lit(0), lambda a, x: a + F.length(x))
    spans = F.transform("parts", lambda p, i: F.struct(i.alias("i"), before(i).alias("start"), (before(i) + F.length(p)).alias("end"), p.alias("text")))
    return lines.withColumn("parts", parts).select("doc_id", "line_no", F.inline(spans)).where("i % 2 = 1").drop("i")
