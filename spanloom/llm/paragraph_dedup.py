"""Substring dedup of paragraphs: MinHash banding, exact Jaccard, connected components.

Each line of SHINGLE words or more is compared, by the set of its SHINGLE-word shingles with A-Z in lower case. Lines of equal sets
are one class. A class has BANDS keys of ROWS minima each, tuned for recall: a pair of similarity 0.8 shares a key with a chance
of 1-(1-0.8**2)**6 = 99.8 %. Classes that share a key are joined with their sets, and exact Jaccard of SIMILAR or more links
them (jaccard.py), however large the bucket. Of each component the line of the smallest doc_id, and there the first, stays; the
others are copies, in the same document too.

A paragraph may be one line, or wrapped over many. So what goes is a run of adjacent copies that has least_words words or
more: a short line alone, such as a licence or a greeting, stays, as that is for line dedup to judge; the lines of a wrapped
paragraph go together.

A passage that several documents hold inside longer lines has no line of its own. It is found by the minima of windows of words (passages.py) over the
whole document, and named with its place and its first document; no line goes for it.

Null text counts as empty: no paragraph. Rows that repeat an id and a text are one document's copies: of equal lines in
them all stay or go together. A null doc_id is less than any other. Very long texts are taken whole; a line is held in one task, a
document too. Ties go by doc_id, then line. An empty table gives an empty result. Only the id and text column are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, passages, scratch
from .suffix_dedup import LEAST, keyed, merged

SHINGLE, LEAST_WORDS = 5, 20
BANDS, ROWS = 6, 2
HELD = 1 << 17
_random = np.random.default_rng(7)
ODD = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sets of shingle hashes."""

    def __init__(self):
        self.words = passages.WordHashes()

    def set_of(self, words: list[bytes]) -> np.ndarray:
        """The sorted set of the hashes of all runs of SHINGLE words; fewer words: of all of them."""
        h = self.words.of(words)
        size = min(SHINGLE, len(h))
        n = len(h) - size + 1
        s = sum((h[i : i + n] * ODD[i] for i in range(1, size)), h[:n] * ODD[0])
        s ^= s >> np.uint64(32)
        return np.unique(s * ODD[5])

    def paragraphs(self, text: bytes, wanted=None):
        """Yields (line number, set) of the lines of SHINGLE words or more."""
        for number, line in enumerate(text.lower().split(b"\n")):
            if wanted is None or number in wanted:
                words = line.split()
                if len(words) >= SHINGLE:
                    yield number, self.set_of(words)


def all_band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The BANDS keys of each set, none of them empty."""
    x = np.concatenate(sets)
    x ^= x >> np.uint64(29)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    minima = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for i in range(BANDS * ROWS):
        h = x * ODD[8 + i]
        h ^= h >> np.uint64(31)
        minima[:, i] = np.minimum.reduceat(h, starts)
    return (minima.reshape(-1, BANDS, ROWS) * ODD[40 : 40 + ROWS]).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    return all_band_keys([shingles])[0]


def _signatures(batches):
    shingler = Shingler()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def rows(out: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch:
        bands = pa.array(list(all_band_keys(sets)) if sets else [], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, kinds)), bands], ["rd", "rk", "par", "c1", "c2", "bands"])

    for b in batches:
        out, sets, held = [], [], 0
        for rd, rk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            for number, s in shingler.paragraphs(text.as_py()):
                c = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                out.append((rd, rk, number, int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True)))
                sets.append(s)
                held += len(s)
            if held > HELD:
                yield rows(out, sets)
                out, sets, held = [], [], 0
        yield rows(out, sets)


def _sets(batches):
    """Rows (rd, rk, text, wanted: array of cid and par, leaves of passages) to rows of (cid, shingles) or of a leaf's windows."""
    shingler = Shingler()
    names = ["cid", "shingles", "rd", "rk", "kh", "sh", "several", "lo", "windows"]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.bool_(), pa.int32(), pa.list_(pa.int64())]
    for b in batches:
        out = []
        for rd, rk, text, wanted, leaves in zip(*(c.to_pylist() for c in b.columns)):
            cids: dict[int, list[int]] = {}
            for w in wanted or ():
                cids.setdefault(w["par"], []).append(w["cid"])
            for number, s in shingler.paragraphs(text, cids):
                out += [(cid, s.tobytes(), *[None] * 7) for cid in cids[number]]
            if leaves:
                out += [(None, None, rd, rk, *x) for x in passages.windows_of(shingler.words.of(text.lower().split()), leaves)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)


def paragraph_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rd, rk, par, first_rd, first_par): the lines of components of two or more, with the line that stays."""
    return _clusters(keyed(docs, id_col, text_col), None)[0]


def _clusters(texts: DataFrame, leaves: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Lines as of paragraph_clusters(), and the windows of passages.mixed() leaves, read in the same pass over the texts."""
    rows = scratch.table(texts.mapInArrow(_signatures, "rd long, rk long, par int, c1 long, c2 long, bands array<long>"), "paragraphs")
    classes = rows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("rd", "par", "rk", "bands")).alias("one"))
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("cid"), "c1", "c2", "n", "one.*"), "classes")
    read = []

    def sets_of(cids: DataFrame) -> DataFrame:
        wanted = classes.join(cids.select("cid").distinct(), "cid", "left_semi").groupBy("rd", "rk").agg(F.collect_list(F.struct("cid", "par")).alias("wanted"))
        if leaves is None:
            wanted = wanted.withColumn("leaves", F.lit(None).cast("array<struct<kh:long,sh:long,several:boolean,at:long>>"))
        else:
            wanted = wanted.join(leaves, ["rd", "rk"], "full")
        cut = texts.join(wanted, ["rd", "rk"]).select("rd", "rk", "text", "wanted", "leaves")
        read.append(scratch.table(cut.mapInArrow(_sets, "cid long, shingles binary, rd long, rk long, kh long, sh long, several boolean, lo int, windows array<long>"), "read"))
        scratch.release(texts.sparkSession)
        return read[0].where("cid is not null").select("cid", "shingles").dropDuplicates(["cid"])

    joined = jaccard.links(classes.select("cid", F.posexplode("bands").alias("band", "key")), sets_of)
    windows = scratch.table(read[0].where("kh is not null").select("rd", "rk", "kh", "sh", "several", "lo", "windows"), "windows")
    scratch.drop(read[0])
    scratch.release(texts.sparkSession)
    named = classes.select("cid", "c1", "c2", "n", "rd", "par").join(joined, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    firsts = named.groupBy("component").agg(F.sum("n").alias("size"), F.min(F.struct("rd", "par")).alias("first"), scratch.salts("c1").alias("salts")).where("size > 1")
    firsts = firsts.select("component", "first", scratch.each_salt("salts").alias("salt"))
    named = named.withColumn("salt", scratch.salt("c1")).join(firsts, ["component", "salt"]).select("c1", "c2", F.col("first.rd").alias("first_rd"), F.col("first.par").alias("first_par"))
    # a line in a third of all documents is one class: its rows are dealt by document too
    salts = rows.groupBy("c1", "c2").agg(scratch.salts("rd", "rk").alias("salts"))
    named = named.join(salts, ["c1", "c2"]).select("c1", "c2", "first_rd", "first_par", scratch.each_salt("salts").alias("salt"))
    lines = rows.withColumn("salt", scratch.salt("rd", "rk")).join(named, ["c1", "c2", "salt"]).select("rd", "rk", "par", "first_rd", "first_par")
    return lines, windows


def removed_lines(lines: list[bytes], copies: set[int], least_words: int) -> list[int]:
    """Numbers of the lines in runs of adjacent copies that have least_words words or more."""
    out: list[int] = []
    run: list[int] = []
    words = 0
    for i in range(len(lines) + 1):
        if i in copies:
            run.append(i)
            words += len(lines[i].split())
        elif run:
            out += run if words >= least_words else []
            run, words = [], 0
    return out


def paragraph_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, n_removed, clusters, kept_sha256) for each row of docs; text is what stays, its lines joined by \\n.

    clusters lists what of the row repeats, by line number and the numbers of the first word in the document and of words:
    - the lines that have near copies, in runs of least_words words or more, with doc_id and line number of the one that stays, and
      whether this one is removed (paragraph_clusters() has the shorter ones too);
    - passages: the runs of words covered by windows of passages.WORDS words that another document holds too, with the least doc_id that
      holds these windows, which may be its own. first_line is null, removed is false: the text loses whole lines only. Runs of different
      first documents may overlap, and a passage may be of lines that are listed too.
    kept_sha256 is of the text that stays, in UTF-8.
    """
    fields = {"line": "int", "first_doc_id": "long", "first_line": "int", "removed": "boolean", "word": "long", "n_words": "long"}
    schema = f"doc_id long, text string, n_removed long, clusters array<struct<{','.join(f'{k}:{v}' for k, v in fields.items())}>>, kept_sha256 string"
    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    kind = pa.list_(pa.struct([(k, arrow[v]) for k, v in fields.items()]))
    own = lambda rd: None if rd == LEAST else rd

    def named(rd, lines, found, spans):
        copies = {x["par"] for x in found if (x["first_rd"], x["first_par"]) != (rd, x["par"])}
        gone, listed = (set(removed_lines(lines, x, least_words)) for x in (copies, {x["par"] for x in found}))
        if not listed and not spans:
            return gone, []
        ends = np.cumsum([len(x.split()) for x in lines])
        first = lambda line: int(ends[line - 1]) if line else 0
        out = [(x["par"], own(x["first_rd"]), x["first_par"], x["par"] in gone, first(x["par"]), int(ends[x["par"]]) - first(x["par"])) for x in found if x["par"] in listed]
        by_first: dict[int, list[tuple[int, int]]] = {}
        for x in spans:
            by_first.setdefault(x["first_rd"], []).append((x["s"], x["e"]))
        out += [(int(np.searchsorted(ends, s, "right")), own(d), None, False, s, e - s) for d, x in by_first.items() for s, e in merged(x)]
        return gone, [dict(zip(fields, x)) for x in sorted(out, key=lambda x: (x[0], x[4], x[2] is None, x[1] is not None, x[1]))]

    def run(batches):
        for b in batches:
            out = []
            for rd, text, found, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                lines = text.as_py().split(b"\n")
                gone, clusters = named(rd, lines, found or [], spans or [])
                kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
                out.append((own(rd), kept.decode(), len(gone), clusters, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.string(), pa.int64(), kind, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["doc_id", "text", "n_removed", "clusters", "kept_sha256"])

    texts = keyed(docs, id_col, text_col)
    shared = passages.shared_anchors(texts)
    leaves = passages.leaves_of(shared)
    lines, windows = _clusters(texts, passages.mixed(leaves))
    spans = scratch.table(passages.repeated_passages(shared, leaves, windows), "spans")
    for done in (shared, leaves, windows):
        scratch.drop(done)
    scratch.release(texts.sparkSession)
    line, span = F.struct("par", "first_rd", "first_par"), F.struct("first_rd", "s", "e")
    found = lines.select("rd", "rk", line.alias("line")).unionByName(spans.select("rd", "rk", span.alias("span")), allowMissingColumns=True)
    found = scratch.table(found.groupBy("rd", "rk").agg(F.collect_set("line").alias("found"), F.collect_set("span").alias("spans")), "found")
    scratch.drop(spans)
    scratch.drop(lines, docs)
    scratch.release(texts.sparkSession)
    return texts.join(found, ["rd", "rk"], "left").select("rd", "text", "found", "spans").mapInArrow(run, schema)


def op6_paragraph_minhash(spark, sf_dir: str) -> DataFrame:
    return paragraph_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
