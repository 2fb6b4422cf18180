"""Line dedup with sharded cuckoo filters backed by exact reference counts.

A line's key is the line without the characters [\\x20\\x09-\\x0D] at both ends and with A-Z in lower case, as 128 bits. The
exact table `holders` has a row for each key of LEAST_CHARS code points or more and each document that holds it; `counts` has the
number of documents and the largest doc_id of each key. Cuckoo filters, one for each shard of the keys, hold the keys of at
least LEAST_DOCS documents. Holders meet only the filter of their shard, in a stream where the filter comes first; what
passes is checked against the exact counts, so a filter's false positives never drop a line. Shards are salted, so that a
line in a third of all documents meets as many copies of its filter, and no filter is broadcast. A filter that is full after
insertions is built anew, larger, from the exact counts, and the number of shards grows with the keys.

insert() and delete() add and take away documents: counts are summed anew from signed holders, and keys that cross the
threshold enter or leave their filter. After deleting what was inserted, everything is as before.

Null or empty text is one empty line. Each row counts as a document; rows that repeat a doc_id share its decisions, and a null
doc_id is less than any other. Very long texts and lines are taken whole, a document in one task. An empty table gives an empty result. Only the id and text column are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD_KEYS = 1 << 19
SALTS = 16
BLANKS = b" \t\n\v\f\r"
NULL_ID = -(2**63)


class Cuckoo:
    """Buckets of four 16-bit fingerprints; a key may be in either of two buckets."""

    def __init__(self, capacity: int = 16):
        self.slots = np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, capacity) / 3.2)))), 4), np.uint16)

    def _places(self, k1: np.ndarray, k2: np.ndarray):
        k1, k2 = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        prints = ((k2 % np.uint64(65535)) + np.uint64(1)).astype(np.uint16)
        first = (k1 & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        return bucket ^ (prints.astype(np.int64) * 0x5BD1E995 & len(self.slots) - 1)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(k1, k2)
        return ((self.slots[a] == prints[:, None]) | (self.slots[b] == prints[:, None])).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> "Cuckoo":
        """This filter with the keys; a larger one is needed when it raises OverflowError."""
        prints, first, other = self._places(k1, k2)
        dice = np.random.default_rng(len(k1))
        for p, a, b in zip(prints, first.tolist(), other.tolist()):
            for _ in range(500):
                free = np.flatnonzero(self.slots[a] == 0)
                if not len(free):
                    a, b = b, a
                    free = np.flatnonzero(self.slots[a] == 0)
                if len(free):
                    self.slots[a, free[0]] = p
                    break
                k = dice.integers(4)
                p, self.slots[a, k] = self.slots[a, k].copy(), p
                b = int(self._other(np.int64(a), p))
            else:
                raise OverflowError("the filter is full")
        return self

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> "Cuckoo":
        """This filter without one copy of each key; only keys that were inserted may be deleted."""
        prints, first, other = self._places(k1, k2)
        for p, a, b in zip(prints, first.tolist(), other.tolist()):
            for bucket in (a, b):
                there = np.flatnonzero(self.slots[bucket] == p)
                if len(there):
                    self.slots[bucket, there[0]] = 0
                    break
        return self

    def tobytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> "Cuckoo":
        out = cls()
        out.slots = np.frombuffer(data, np.uint16).reshape(-1, 4).copy()
        return out


def line_keys(text: bytes) -> list[tuple[bytes, bytes | None]]:
    """(line, key) of each line; the key is None where the line is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANKS).lower()
        long = len(key) >= LEAST_CHARS and (len(key) >= 4 * LEAST_CHARS or len(key.decode(errors="replace")) >= LEAST_CHARS)
        out.append((line, hashlib.blake2b(key, digest_size=16).digest() if long else None))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("rd"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _holder_rows(batches):
    for b in batches:
        ids, keys = [], []
        for rd, text in zip(b.column(0).to_pylist(), b.column(1)):
            own = {k for _, k in line_keys(text.as_py()) if k}
            keys += own
            ids += [rd] * len(own)
        parts = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(parts[:, 0]), pa.array(parts[:, 1]), pa.array(ids, pa.int64())], ["k1", "k2", "rd"])


def holders_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, rd): each long enough key of each row once."""
    return _keyed(docs, id_col, text_col).mapInArrow(_holder_rows, "k1 long, k2 long, rd long")


def _build(batches):
    """Rows (shard, k1, k2, gone) sorted by shard, with the shard's old filter in a first row, to (shard, filter)."""
    shard, held, put, out = None, None, [], []

    def finish(old, rows) -> bytes | None:
        keys = np.array(rows, np.int64).reshape(-1, 3)
        new, gone = keys[keys[:, 2] == 0], keys[keys[:, 2] == 1]
        size = max(16, 2 * len(new))
        while True:
            try:
                found = Cuckoo.frombytes(old) if old else Cuckoo(size)
                return found.delete(gone[:, 0], gone[:, 1]).insert(new[:, 0], new[:, 1]).tobytes()
            except OverflowError:
                if old:
                    return None  # to be built anew from all keys
                size *= 2

    for b in batches:
        for s, k1, k2, gone, old in zip(*(c.to_pylist() for c in b.columns)):
            if s != shard:
                if shard is not None:
                    out.append((shard, finish(held, put)))
                shard, held, put = s, None, []
            if old is not None:
                held = old
            else:
                put.append((k1, k2, gone))
    if shard is not None:
        out.append((shard, finish(held, put)))
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([f for _, f in out], pa.binary())], ["shard", "filter"])


def _pass(batches):
    """Rows (shard, salt, filter, k1, k2, rd) sorted so that each shard's filter comes first; lets through what is in it."""
    shard, cuckoo = None, None
    for b in batches:
        shards, isfilter = b.column(0).to_numpy(zero_copy_only=False), b.column(2).is_valid().to_numpy(zero_copy_only=False)
        k1, k2, rd = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        keep = np.zeros(len(shards), bool)
        cuts = np.flatnonzero((shards[1:] != shards[:-1]) | isfilter[1:]) + 1 if len(shards) else []
        for s, e in zip([0, *cuts], [*cuts, len(shards)]) if len(shards) else ():
            if shards[s] != shard:
                shard, cuckoo = shards[s], None
            if isfilter[s]:
                cuckoo = Cuckoo.frombytes(b.column(2)[int(s)].as_py())
                s += 1
            if cuckoo is not None and s < e:
                keep[s:e] = cuckoo.contains(k1[s:e], k2[s:e])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k1, k2, rd)], ["k1", "k2", "rd"])


class LineIndex:
    """Signed holders, exact counts and filters, all of them tables in the shared folder."""

    def __init__(self, holders: DataFrame, shards: int | None = None, old: "LineIndex | None" = None):
        """holders: (k1, k2, rd, sign), written out."""
        self.spark, self.holders = holders.sparkSession, holders
        if old is not None:  # what was inserted and deleted is gone before the largest id is taken
            self.holders = scratch.table(holders.groupBy("k1", "k2", "rd").agg(F.sum("sign").cast("int").alias("sign")).where("sign > 0"), "holders")
        counts = self.holders.groupBy("k1", "k2").agg(F.sum("sign").alias("docs"), F.max("rd").alias("last"))
        self.frequent = scratch.table(counts.where(F.col("docs") >= LEAST_DOCS), "frequent")
        wanted = max(4, self.frequent.count() // SHARD_KEYS)
        self.shards = wanted if shards is None or wanted > 2 * shards else shards
        new = self.frequent.select("k1", "k2", F.lit(0).alias("gone"))
        filters = None
        if old is not None and old.shards == self.shards:
            both = new.join(old.frequent.select("k1", "k2", F.lit(True).alias("was")), ["k1", "k2"], "full")
            new = both.where("was is null or gone is null").select("k1", "k2", F.when(F.col("was").isNull(), 0).otherwise(1).alias("gone"))
            filters = old.filters.select("shard", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(-1).alias("gone"), "filter")
        self.filters = self._built(new, filters)
        if filters is not None and self.filters.where("filter is null").head(1):  # full ones grow
            full = self.filters.where("filter is null").select("shard")
            again = self.frequent.select("k1", "k2", F.lit(0).alias("gone")).withColumn("shard", self._shard()).join(full, "shard", "left_semi").drop("shard")
            self.filters = scratch.table(self.filters.where("filter is not null").unionByName(self._built(again)), "filters")

    def _built(self, keys: DataFrame, filters: DataFrame | None = None) -> DataFrame:
        """(shard, filter): keys (k1, k2, gone) put into filters or taken out of them; null where an old filter is full."""
        rows = keys.select(self._shard(), "k1", "k2", "gone", F.lit(None).cast("binary").alias("filter"))
        rows = rows.unionByName(filters) if filters is not None else rows
        dealt = rows.repartition(scratch.partitions(self.spark), "shard").sortWithinPartitions("shard", "gone")
        return scratch.table(dealt.mapInArrow(_build, "shard int, filter binary"), "filters")

    def _shard(self):
        return F.pmod(F.col("k1").bitwiseXOR(F.shiftrightunsigned("k1", 32)), F.lit(self.shards)).cast("int").alias("shard")

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> "LineIndex":
        return cls(scratch.table(holders_of(docs, id_col, text_col).withColumn("sign", F.lit(1)), "holders"), shards)

    def _with(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> "LineIndex":
        more = holders_of(docs, id_col, text_col).withColumn("sign", F.lit(sign))
        return LineIndex(scratch.table(self.holders.unionByName(more), "holders"), self.shards, self)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        return self._with(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        """docs: documents as they were inserted."""
        return self._with(docs, -1, id_col, text_col)

    def passing(self, holders: DataFrame) -> DataFrame:
        """The rows (k1, k2, rd) of holders whose key is in its shard's filter."""
        salt = F.pmod(F.xxhash64("rd"), F.lit(SALTS)).cast("int").alias("salt")
        keys = holders.select(self._shard(), salt, F.lit(None).cast("binary").alias("filter"), "k1", "k2", "rd")
        copies = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "filter", *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "rd")])
        both = copies.unionByName(keys).repartition(scratch.partitions(self.spark), "shard", "salt")
        return both.sortWithinPartitions("shard", "salt", F.col("filter").isNull()).mapInArrow(_pass, "k1 long, k2 long, rd long")

    def drops(self) -> DataFrame:
        """(rd, keys): of each document the keys whose lines it loses."""
        passing = scratch.table(self.passing(self.holders.select("k1", "k2", "rd")), "passing")
        bits = passing.groupBy("k1", "k2").agg(scratch.salts("rd").alias("bits"))  # a line in a third of all documents is dealt by document too
        exact = self.frequent.join(bits, ["k1", "k2"]).select("k1", "k2", "last", scratch.each_salt("bits").alias("salt"))
        sure = passing.withColumn("salt", scratch.salt("rd")).join(exact, ["k1", "k2", "salt"]).where("rd <> last")
        return sure.groupBy("rd").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def _kept(text: bytes, keys) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the text that stays."""
    lines = line_keys(text)
    gone = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys or ()}
    stay = [line for line, key in lines if key is None or key not in gone]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def line_dedup(docs: DataFrame, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of docs; index: of all documents that count, docs by default."""
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    drops = (index or LineIndex.build(docs, id_col, text_col)).drops()

    def run(batches):
        for b in batches:
            out = []
            for rd, text, keys in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                n, dropped, kept = _kept(text.as_py(), keys)
                out.append((None if rd == NULL_ID else rd, n, dropped, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 4, kinds)], [c.split()[0] for c in schema.split(", ")])

    return _keyed(docs, id_col, text_col).join(drops, "rd", "left").select("rd", "text", "keys").mapInArrow(run, schema)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(range(1, len(lines) + 1)) AS u(i)
), f AS (
  SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3
), m AS (
  SELECT l.r, l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id IS DISTINCT FROM f.last AS dropped FROM l LEFT JOIN f ON l.k = f.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r
"""
