"""Readers: files of many formats to one row of text each. None raises for a file: ok and error say what happened."""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import json
import re
import sys
import warnings
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FORMATS = {"txt": "txt", "md": "txt", "log": "txt", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "html": "html", "htm": "html", "xml": "xml", "docx": "docx", "eml": "eml", "pdf": "pdf"}
SKIPPED = {"script", "style", "noscript", "template", "svg", "object", "iframe"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "article", "section", "header", "footer", "title"}


def format_of(path: Column) -> Column:
    """The format of a path by its suffix, else null."""
    suffix = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return F.coalesce(*[F.when(suffix == k, F.lit(v)) for k, v in FORMATS.items()])


def decode(content: Column) -> Column:
    """UTF-8, or else Latin-1; without a byte order mark."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def is_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes, or over a tenth of control characters there; a UTF-16 mark means text."""
    head = F.substring(content, 1, 8192)
    as_text = F.decode(head, "ISO-8859-1")
    control = F.length(as_text) - F.length(F.regexp_replace(as_text, "[\\x00-\\x08\\x0B\\x0E-\\x1F]", ""))
    mark = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return ~mark & (as_text.contains("\x00") | (control * 10 > F.length(as_text)))


def json_lines(text: str) -> str:
    """`key: value` for each string, depth first; items of a list have its key. What isn't JSON stays as it is, line by line."""
    out: list[str] = []

    def walk(value, key):
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, k)
        elif isinstance(value, list):
            for v in value:
                walk(v, key)
        elif isinstance(value, str) and value.strip():
            out.append(f"{key}: {value}" if key else value)

    try:
        walk(json.loads(text), "")
    except ValueError:
        for line in text.splitlines():
            try:
                walk(json.loads(line), "")
            except ValueError:
                out.append(line)
    return "\n".join(out)


class _Page(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED
        self.out.append("\n" if tag in BLOCKS else " | " if tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        self.depth -= tag in SKIPPED and self.depth > 0
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def html_text(text: str) -> str:
    page = _Page()
    page.feed(text)
    page.close()
    rows = (" ".join(line.split()).strip(" |") for line in "".join(page.out).split("\n"))
    return "\n".join(r for r in rows if r)


def xml_lines(text: str) -> str:
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return html_text(text)
    out: list[str] = []

    def walk(e):
        out.extend(f"{k.rpartition('}')[2]}: {v}" for k, v in e.attrib.items() if any(c.isalpha() for c in v))
        out.extend(" ".join(x.split()) for x in [e.text or ""] if x.strip())
        for child in e:
            walk(child)
            out.extend(" ".join(x.split()) for x in [child.tail or ""] if x.strip())

    walk(root)
    return "\n".join(out)


def docx_lines(content: bytes) -> str:
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    text = lambda e: "".join(t.text or "" for t in e.iter(word + "t"))
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))[0]
        for e in body:
            if e.tag == word + "tbl":
                out += [" | ".join(text(c) for c in row.iter(word + "tc")) for row in e.iter(word + "tr")]
            else:
                out.append(text(e))
        parts = set(z.namelist())
        for part in ("footnotes", "endnotes", "comments"):
            if f"word/{part}.xml" in parts:
                for note in ET.fromstring(z.read(f"word/{part}.xml")):
                    out += [text(p) for p in note.iter(word + "p")]
                    out += [f"Comment author: {note.get(word + 'author')}"] if note.get(word + "author") else []
        if "docProps/core.xml" in parts:
            known = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in ET.fromstring(z.read("docProps/core.xml"))}
            out += [f"{label}: {known[k]}" for k, label in (("creator", "Document author"), ("lastModifiedBy", "Last modified by")) if known.get(k)]
    return "\n".join(x for x in out if x.strip())


def eml_text(content: bytes) -> str:
    m = email.message_from_bytes(content, policy=email.policy.default)
    values = ((k, " ".join(str(v).split())) for k in ("From", "Sender", "Reply-To", "To", "Cc", "Bcc", "Subject", "Date") for v in m.get_all(k) or [])
    head = [f"{k}: {v}" for k, v in values if v]
    body = m.get_body(("plain",)) or m.get_body(("html",))
    text = body.get_content() if body else ""
    return "\n".join([*head, "", html_text(text) if body and body.get_content_subtype() == "html" else text])


PARSERS = {"json": lambda raw, t: json_lines(t), "html": lambda raw, t: html_text(t), "xml": lambda raw, t: xml_lines(t), "docx": lambda raw, t: docx_lines(raw), "eml": lambda raw, t: eml_text(raw)}


def _parsed(parsers: dict[str, Callable]):
    """The Arrow UDF (format, content, text) to (text, error) of these parsers."""

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
    def run(kinds: pd.Series, contents: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, raw, text in zip(kinds, contents, texts):
            try:
                rows.append((parsers[kind](raw, text), None))
            except Exception as e:  # a broken file is a row with an error, never a failed task
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return run


def csv_lines(text: Column, separator: Column) -> Column:
    """Records as lines, cells joined by " | ", for texts without quotes."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.array_join(F.transform(F.split(line, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1), lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))), " | ")), "\n")


@F.pandas_udf(StringType())
def _quoted_lines(texts: pd.Series, separators: pd.Series) -> pd.Series:
    """csv_lines() for texts with quotes: a quoted cell may hold separators and line ends, which become blanks."""
    csv.field_size_limit(sys.maxsize)

    def lines(text, separator):
        if text is None:
            return None
        records = csv.reader(io.StringIO(text, newline=""), delimiter=separator)
        return "\n".join([*(" | ".join(" ".join(c.split()) for c in r) for r in records), *([""] if text.endswith("\n") else [])])

    return pd.Series([lines(t, s) for t, s in zip(texts, separators)], dtype=object)


def parse(files: DataFrame, more: dict[str, Callable] | None = None) -> DataFrame:
    """files: (path, content). (path, format, ok, error, skipped, text); only structured formats and CSV with quotes go through Python.

    more: parsers of the user's by format, functions (bytes, decoded text or None) to text; one for pdf has its files read,
    which are passed over without.
    """
    from ..functions.text import delimiter

    parsers = {**PARSERS, **(more or {})}
    rows = files.select("path", "content", format_of(F.col("path")).alias("format"), is_binary(F.col("content")).alias("binary"))
    rows = rows.withColumn("raw", F.when(~F.col("binary") & ~F.col("format").isin("docx", "pdf"), decode(F.col("content"))))
    rows = rows.withColumn("skipped", F.when(F.col("format").isNull(), "unsupported").when(F.col("binary") & ~F.col("format").isin("docx", "pdf"), "binary_content").when((F.col("format") == "pdf") & F.lit("pdf" not in parsers), "no_pdf_reader"))
    parsed = F.when(F.col("skipped").isNull() & F.col("format").isin(*parsers), _parsed(parsers)("format", "content", "raw"))
    separator = F.when(F.col("path").endswith(".tsv"), "\t").otherwise(delimiter(F.substring_index(F.ltrim("raw"), "\n", 1)))
    quoted = F.col("raw").contains('"')
    rows = rows.withColumn("parsed", parsed).withColumn("cells", F.when((F.col("format") == "csv") & quoted, _quoted_lines("raw", separator)))
    text = F.when(F.col("format").isin(*(more or {})), F.col("parsed.text")).when(F.col("format") == "txt", F.col("raw")).when((F.col("format") == "csv") & quoted, F.col("cells")).when(F.col("format") == "csv", csv_lines(F.col("raw"), separator)).otherwise(F.col("parsed.text"))
    return rows.select("path", "format", (F.col("skipped").isNull() & F.col("parsed.error").isNull()).alias("ok"), F.col("parsed.error").alias("error"), "skipped", F.when(F.col("skipped").isNull(), text).alias("text"))


def read_folder(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """All files below a folder, but those whose path matches the pattern exclude."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parse(files.where(~F.col("path").rlike(exclude)) if exclude else files)


def manifest_paths(text: str) -> list[str]:
    """The paths that a list of files names: a line each, without comments, empty lines and one layer of quotation marks."""
    lines = (line.strip() for line in text.removeprefix("\ufeff").splitlines())
    return [line[1:-1] if len(line) > 1 and line[0] == line[-1] and line[0] in "\"'" else line for line in lines if line and not line.startswith("#")]


def read_manifest(spark: SparkSession, path: str, at_most: int = 200) -> DataFrame | None:
    """parse() of the files that a list names, or None where the file is no list: it has no line, over at_most, or none that is there.

    A list is small by definition; only its head is brought to the driver. Paths that are missing are left out with a warning.
    """
    head = spark.read.text(path).where("btrim(value) <> '' and not startswith(btrim(value), '#')").limit(at_most + 1).collect()
    paths = manifest_paths("\n".join(r.value for r in head))
    if not paths or len(paths) > at_most or max(map(len, paths)) > 260:
        return None
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return None
    for p in sorted(set(paths) - set(there)):
        warnings.warn(f"{path}: no file {p}", stacklevel=2)
    return parse(spark.read.format("binaryFile").load(list(dict.fromkeys(there))).select("path", "content"))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    except (Py4JJavaError, IllegalArgumentException):  # no path at all, such as a line of prose with a colon
        return False


def excluded_by(path: Column, globs: list[str]) -> Column:
    """The first pattern that matches a path's last part or the whole path in any case, else null; a backslash counts as a slash."""
    path = F.lower(F.translate(path, "\\", "/"))
    name = F.substring_index(path, "/", -1)
    regexes = [(g, "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g.lower().replace("\\", "/")) + "$") for g in globs]
    return F.coalesce(*[F.when(name.rlike(r) | path.rlike(r), F.lit(g)) for g, r in regexes], F.lit(None).cast("string"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(key): the lines of a list in lower case, without comments and empty ones."""
    keys = spark.read.text(path).select(F.lower(F.btrim("value")).alias("key"))
    return keys.where("key <> '' and not startswith(key, '#')").distinct()
