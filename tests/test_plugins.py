"""Lists, detectors and parsers of the user's, and state that goes when it is idle."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import candidates, context, detect, lexicon, refine
from spanloom.plans.queries import extracted
from spanloom.sources import readers
from spanloom.streaming import sessions


def words_found(docs):
    return {(r.text, r.pattern) for r in detect.detections(docs).collect()}


def test_lists_can_be_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(1, "then Zoë Quill met Anna Keller")], "doc_id long, text string")
    (tmp_path / "first.txt").write_text("# names\nzoe\n\nZoe\n")
    with lexicon.using(lexicon.read_lists({"first": readers.word_list(spark, str(tmp_path / "first.txt"))}) | {"last": ["Quill"]}):
        assert lexicon.keys("first") == ["zoe"] and lexicon.keys("last") == ["quill"]
        found = words_found(docs)
    assert ("Zoë Quill", "dictionary") in found and ("Anna Keller", "dictionary") not in found
    assert ("Anna Keller", "dictionary") in words_found(docs) and ("Zoë Quill", "dictionary") not in words_found(docs)
    with lexicon.using({"first": [], "last": [], "stopword": []}):
        assert {p for _, p in words_found(docs)} == {"bare"}
    with pytest.raises(ValueError), lexicon.using({"nothing": ["a"]}):
        pass
    with pytest.raises(ValueError), lexicon.using({"first": [str(i) for i in range(lexicon.MOST_KEYS + 1)]}):
        pass


def test_marks_fold_one_way_only(spark):
    with lexicon.using({"first": ["zoë", "jose"], "last": ["weiss"]}):
        rows = spark.createDataFrame([("zoe",), ("zoë",), ("josé",), ("jose",), ("weiß",), ("",), (None,)], "key string").select("key", lexicon.name_key(F.col("key")).alias("k"))
        assert {r.key: r.k for r in rows.collect()} == {"zoe": "zoe", "zoë": "zoë", "josé": "jose", "jose": "jose", "weiß": "weiss", "": "", None: None}


def test_models_and_other_detectors_join_in(spark):
    docs = spark.createDataFrame([(1, "no\nsee xi Wang 2b Li here\nBROKEN Line"), (2, None)], "doc_id long, text string")

    def load():
        def find(line):
            if "BROKEN" in line:
                raise ValueError(line)
            return [(4, 17)]

        return find

    by_model = lambda d, text: detect.model_spans(d, load, text)
    got = {(r.line_no, r.start, r.end, r.text) for r in detect.detections(docs, more=[by_model]).where("pattern = 'model'").collect()}
    assert got == {(2, 4, 11, "xi Wang"), (2, 15, 17, "Li")}
    merged = candidates.canonical(candidates.overlap_groups(detect.detections(docs, more=[by_model])))
    assert "model" in {p for r in merged.collect() for p in r.patterns}


def test_parsers_of_the_users(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"%PDF Anna")), ("b.txt", bytearray(b"hello")), ("c.pdf", bytearray(b""))], "path string, content binary")
    assert {r.skipped for r in readers.parse(files).where("format = 'pdf'").collect()} == {"no_pdf_reader"}

    def pdf(raw, text):
        assert text is None and raw
        return raw.decode()[5:]

    got = {r.path: (r.ok, r.text) for r in readers.parse(files, {"pdf": pdf}).collect()}
    assert got == {"a.pdf": (True, "Anna"), "b.txt": (True, "hello"), "c.pdf": (False, None)}


def test_a_first_name_is_found_where_no_detector_saw_it(spark):
    lines = "Dr. Ümit Öztürk spoke.\nwe heard Ümit there\nÜmit, Anna Smith came\nsee http://Ümit now\nso Quark Ümit Smith left"
    docs = spark.createDataFrame([(1, lines), (2, "we heard Ümit there")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r for r in extracted(docs).where("text = 'Ümit'").collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 4)}  # not in line 5, right before a candidate, and not without an accepted full name
    assert got[1, 2].decision == "accepted" and got[1, 2].patterns == ["document_name"] and got[1, 2].reps == 5
    assert got[1, 4].failed == "context" and got[1, 4].decision == "rejected"
    none = extracted(docs.where("doc_id = 3"))
    assert none.isEmpty()


def test_promotion_and_caps_look_at_the_whole_document(spark):
    line = "Dr. Anna Stone came\nlater Anna\nlater Stone"
    docs = spark.createDataFrame([(1, line), (2, "later Anna\nlater Stone")], "doc_id long, text string")
    cands = candidates.canonical(candidates.overlap_groups(detect.detections(docs)))
    judged = context.judged_in_context(candidates.judged(cands), docs)
    risen = {(r.doc_id, r.text): r.decision for r in refine.promoted(judged).collect()}
    assert risen[1, "Anna"] == "accepted" and risen[2, "Anna"] != "accepted"
    forced = judged.withColumn("decision", F.lit("accepted"))
    capped = {(r.doc_id, r.text): r.decision for r in refine.capped(forced).collect()}
    assert capped[1, "Stone"] == "accepted" and capped[2, "Stone"] == "review"


def test_idle_conversations_are_forgotten(spark, tmp_path):
    rows = [(1, t, "x" * 30) for t in range(5)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    q = sessions.stream_windows(stream, 100, idle_minutes=1).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(20)
    q.stop()
    assert sorted(spark.table("idle").collect()) == sorted(sessions.rolling_window(messages, 100).collect())
