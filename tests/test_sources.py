import io
import zipfile

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import candidates, feedback
from spanloom.sources import readers
from spanloom.streaming import sessions


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>Dear Anna</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


FILES = {
    "a.txt": (b"\xef\xbb\xbfhello", "hello"), "b.TXT": ("caf\xe9".encode("latin-1"), "café"), "c.csv": (b"x;y;z\n1 ;  2;3", "x | y | z\n1 | 2 | 3"), "d.tsv": (b"a\tb,c", "a | b,c"),
    "e.json": (b'{"a": [" x ", 1, {"b": "y"}], "c": ""}', "a:  x \nb: y"), "f.jsonl": (b'{"a": "x"}\nnot json', "a: x\nnot json"), "g.html": (b"<p>A &amp; B<script>no</script></p><table><tr><td>1<td>2</table>", "A & B\n1 | 2"),
    "h.xml": (b'<r a="n1" b="2"><x>one</x>two</r>', "a: n1\none\ntwo"), "i.xml": (b"<p>broken", "broken"), "j.eml": (b"From: a@x.org\nSubject: Hi\n\nBody text", "From: a@x.org\nSubject: Hi\n\nBody text"), "k.docx": (docx(), "Dear Anna\na | b"),
}


def test_formats(spark):
    rows = [(f"/x/{p}", bytearray(c)) for p, (c, _) in FILES.items()]
    rows += [("/x/l.docx", bytearray(b"junk")), ("/x/m.txt", bytearray(b"a\0b")), ("/x/n.xyz", bytearray(b"?")), ("/x/o.pdf", bytearray(b"%PDF")), ("/x/p.txt", bytearray(b""))]
    got = {r.path: r for r in readers.parse(spark.createDataFrame(rows, "path string, content binary")).collect()}
    for p, (_, want) in FILES.items():
        assert got[f"/x/{p}"].ok and got[f"/x/{p}"].text.strip() == want.strip(), p
    assert not got["/x/l.docx"].ok and "BadZipFile" in got["/x/l.docx"].error
    assert [got[f"/x/{p}"].skipped for p in ("m.txt", "n.xyz", "o.pdf")] == ["binary_content", "unsupported", "no_pdf_reader"]
    assert got["/x/p.txt"].ok and got["/x/p.txt"].text == ""


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_text("one")
    (tmp_path / "skip.log").write_text("two")
    assert [r.text for r in readers.read_folder(spark, str(tmp_path), r"skip").collect()] == ["one"]


def test_nfkc_only_where_needed(spark):
    df = spark.createDataFrame([("ﬁ\x01x  \r\ny",), (None,), ("a\r",)], "t string").select(T.clean_text(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["fix\ny", None, "a\n"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, "x" * ((c * 7 + t * 13) % 50)) for c in range(6) for t in range(12)] + [(9, 0, None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    messages.where("turn < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    messages.where("turn >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.stream_windows(stream, 100).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("windows").collect()) == sorted(sessions.rolling_window(messages, 100).collect())


def test_stopword_edges(spark):
    names = ["The Of Anna Keller and the", "the of", "Of", "Anna"]
    df = spark.createDataFrame([(n,) for n in names], "name string").select(candidates.trim_stopwords(F.col("name")).alias("t"))
    assert [r.t for r in df.collect()] == ["Anna Keller", "of", "Of", "Anna"]


def test_balance_guard(spark):
    df = spark.createDataFrame([(1,)] * 31 + [(0,)] * 10, "y int")
    assert [r.trainable for r in feedback.balance(df, F.col("y")).collect()] == [False]


def test_entry_without_the_training_data_part(monkeypatch):
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def gone(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "spanloom.llm" or name.startswith("spanloom.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name="spanloom.llm")
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert "decisions" in __spark_entry__.queries() and not any(q.startswith("op1_") for q in __spark_entry__.queries())


def test_quoted_cells_hold_separators_and_line_ends(spark):
    files = [("a.csv", b'id,name\r\n1,"Smith, Anna\nMaria"\r\n2,"a ""b"" c"\r\n'), ("b.tsv", b'x\t"p\tq"\ny\tz'), ("c.csv", b"a,b\n1,2")]
    got = {r.path: r.text for r in readers.parse(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a.csv": 'id | name\n1 | Smith, Anna Maria\n2 | a "b" c\n', "b.tsv": "x | p q\ny | z", "c.csv": "a | b\n1 | 2"}


def test_headers_notes_and_authors():
    assert readers.eml_text(b"From: a@x.org\nTo: b@x.org\nTo:  c@x.org\n\nText").split("\n")[:3] == ["From: a@x.org", "To: b@x.org", "To: c@x.org"]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {w}><w:footnote><w:p><w:r><w:t>See Anna</w:t></w:r></w:p></w:footnote></w:footnotes>")
        z.writestr("word/comments.xml", f'<w:comments {w}><w:comment w:author="Karl"><w:p><w:r><w:t>Why?</w:t></w:r></w:p></w:comment></w:comments>')
        z.writestr("docProps/core.xml", '<c:p xmlns:c="c" xmlns:dc="d"><dc:creator>Maria</dc:creator><c:lastModifiedBy> Peter </c:lastModifiedBy></c:p>')
    assert readers.docx_lines(out.getvalue()) == "Body\nSee Anna\nWhy?\nComment author: Karl\nDocument author: Maria\nLast modified by: Peter"


def test_manifest(spark, tmp_path):
    import pytest

    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.csv").write_text("x,y")
    (tmp_path / "list.txt").write_text(f"# files\n\"{tmp_path}/a.txt\"\n\n{tmp_path}/b.csv\n{tmp_path}/none.txt\n")
    with pytest.warns(UserWarning, match="none.txt"):
        got = readers.read_manifest(spark, str(tmp_path / "list.txt"))
    assert sorted(r.text for r in got.collect()) == ["one", "x | y"]
    (tmp_path / "prose.txt").write_text("so said: Anna\n")
    assert readers.read_manifest(spark, str(tmp_path / "prose.txt")) is None
    (tmp_path / "empty.txt").write_text("# nothing\n")
    assert readers.read_manifest(spark, str(tmp_path / "empty.txt")) is None


def test_line_around(spark):
    from spanloom.operators import context

    rows = spark.createDataFrame([("abcdefghij", 0), ("abcdefghij", 5), ("abcdefghij", 9), ("abc", 2)], "line string, start int")
    assert [r.x for r in rows.select(context.line_around(F.col("line"), F.col("start"), 4).alias("x")).collect()] == ["abcd", "defg", "ghij", "abc"]


def test_medians(spark):
    from spanloom.operators import evaluate

    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", None), ("c", None)], "s string, v double")
    assert sorted(map(tuple, evaluate.medians(rows, "s", "v").collect())) == [("a", 3, 2.0), ("b", 2, 1.5)]
