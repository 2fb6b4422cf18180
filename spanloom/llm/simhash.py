"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits. Each bit position i has a vector m(i), not zero, of RADIUS+1 bits; each vector v that isn't zero
gives a table whose mask keeps the positions with an odd number of ones in m(i) & v. Two fingerprints that differ in up to
RADIUS positions span at most RADIUS of the RADIUS+1 dimensions with their m(i), so some v is orthogonal to all of them:
in that table the mask hides every difference and the pair collides. So no pair is missed, with 2**(RADIUS+1)-1 tables.

Equal fingerprints are one class before any table is built. Classes of a bucket are compared bit by bit, and a bucket gives
the edges of a spanning forest, never all its pairs. Buckets of more than BUCKET classes are dealt again by the tables of
other vectors m, which cover all pairs just as well; what shares both keys agrees in about 50 bits, which bounds its size.

Null text counts as empty. Texts without words have fingerprint 0 and are linked like any other. Rows that repeat an id
each get their row. A null doc_id has a fingerprint and a component, but never names one unless all ids in it are null. Very
long texts are hashed whole, a block of shingles at a time. Equal fingerprints, ties among them, are one class. An empty
table gives an empty result. Only the id and text column are read.

keep_one() uses the same tables for near copies in the sense of word shingles: see similar_classes().
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jaccard, scratch
from .components import connected_components
from .paragraph_dedup import Shingler
from .passages import CACHED

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 1024
BLOCK = 1 << 16
PRINTS = 6


def shingle_hashes(words: list[bytes], size: int):
    """Arrays of the XXH64 of each run of size words, a block at a time; fewer words: of all of them."""
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half the shingles' hashes. As a signed long."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes((text or "").encode().lower().split(), size):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), size) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, seed: int) -> list[int]:
    """A mask for each table, as signed longs. The vectors are dealt evenly, in an order that seed sets."""
    vectors = np.tile(np.arange(1, 1 << (radius + 1)), 64)[:64]
    vectors = vectors[np.random.default_rng(seed).permutation(64)]
    kept = [sum(1 << i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [k - (1 << 64) if k >> 63 else k for k in kept]


def _keys(masked: list[int], fp: str):
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masked)]))


def _forests(radius: int):
    """Rows (t, key, t2, key2, fp) sorted by bucket to edges (u, v): each bucket's spanning forest."""

    def forest(fps: np.ndarray):
        rest = np.unique(fps)
        while len(rest) > 1:
            tree, rest = rest[:1], rest[1:]
            while len(tree) and len(rest):
                head, tree = tree[0], tree[1:]
                near = np.bitwise_count((rest ^ head).view(np.uint64)) <= radius  # of signed numbers it counts the absolute value's bits
                for x in rest[near].tolist():
                    yield head, x
                tree, rest = np.concatenate([tree, rest[near]]), rest[~near]

    def run(batches):
        held: list[np.ndarray] = []
        last = None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            fps = b.column(4).to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            parts = np.split(fps, cuts)
            firsts = keys[np.concatenate([[0], cuts])]
            edges = []
            if last is not None and (firsts[0] != last).any():
                edges += forest(np.concatenate(held))
                held = []
            for p in parts[:-1]:
                edges += forest(np.concatenate([*held, p]) if held else p)
                held = []
            held.append(parts[-1])
            last = firsts[-1]
            if edges:
                yield _edge_batch(edges)
        if held:
            yield _edge_batch(list(forest(np.concatenate(held))))

    return run


def _edge_batch(edges: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(u) for u, _ in edges], pa.int64()), pa.array([int(v) for _, v in edges], pa.int64())], ["u", "v"])


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect the fingerprints fp of classes just as all pairs within the radius would."""
    dealt = classes.select("fp", _keys(masks(radius, 1), "fp").alias("x")).select("fp", "x.*")
    sizes = dealt.groupBy("t", "key").count().where("count > 1")
    rows = dealt.join(sizes, ["t", "key"])
    small = rows.where(F.col("count") <= bucket).select("t", "key", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2"), "fp")
    large = rows.where(F.col("count") > bucket).select("t", "key", "fp", _keys(masks(radius, 2), "fp").alias("x"))
    both = small.unionByName(large.select("t", "key", F.col("x.t").alias("t2"), F.col("x.key").alias("key2"), "fp"))
    keys = ["t", "key", "t2", "key2"]
    dealt_out = both.repartition(scratch.partitions(classes.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt_out.mapInArrow(_forests(radius), "u long, v long")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of prints (doc_id, fp), written out: component_id is the smallest doc_id reachable."""
    classes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    joined = connected_components(links(classes, radius)).select(F.col("node").alias("fp"), "component")
    named = classes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("fp", "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for each row of docs."""
    prints = scratch.table(fingerprints(docs, size, id_col, text_col), "prints")
    return prints.join(_components(prints, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def word_prints(text: str, known: dict[bytes, bytes]) -> tuple[bytes, np.ndarray]:
    """A digest of the text's words in lower case, and PRINTS fingerprints of the set of them; known keeps words' hashes."""
    words = text.encode().lower().split()
    every, ones = list(set(words)), np.zeros(64 * PRINTS, np.int64)
    if len(known) > CACHED:
        known.clear()
    for w in set(every).difference(known):
        known[w] = hashlib.blake2b(w, digest_size=8 * PRINTS).digest()
    for i in range(0, len(every), BLOCK):
        part = np.frombuffer(b"".join(map(known.__getitem__, every[i : i + BLOCK])), np.uint8).reshape(-1, 8 * PRINTS)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest(), np.packbits(2 * ones > len(every), bitorder="little").view(np.int64)


def _word_rows(batches):
    """Rows (doc_id, sha, n, text) to (doc_id, sha, n, c1, c2, prints); prints is empty where there is no word."""
    known: dict[bytes, bytes] = {}
    for b in batches:
        found = [word_prints(t.as_py(), known) for t in b.column(3)]
        parts = np.frombuffer(b"".join(d for d, _ in found), np.int64).reshape(-1, 2)
        prints = pa.array([p if p.any() else [] for _, p in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(parts[:, 0]), pa.array(parts[:, 1]), prints], ["doc_id", "sha", "n", "c1", "c2", "prints"])


def _whole_sets(batches):
    """Rows (cid, text) to (cid, shingles)."""
    shingler = Shingler()
    for b in batches:
        sets = [shingler.set_of(t.as_py().encode().lower().split()).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])


def similar_classes(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(component, doc_id, n, sha) of one row of each class of equal word sequences: the first by doc_id (null last), length, hash.

    Classes that share a key of a covering table are compared, and linked where the exact Jaccard of their five-word shingles is 0.8
    or more (texts of fewer words: one shingle). A text's keys are those of PRINTS fingerprints of the set of its words:
    one word more or less moves them far less than fingerprints of shingles, of which it changes five. Within the radius in
    any of these no pair is missed; beyond it a pair has many more chances to share a key, and the exact check decides.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), F.length(text).alias("n"), text.alias("text"))
    prints = scratch.table(rows.mapInArrow(_word_rows, "doc_id long, sha string, n int, c1 long, c2 long, prints array<long>"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", (-F.col("n")).alias("n"), "sha", "prints"))
    classes = prints.groupBy("c1", "c2").agg(first.alias("first")).select(F.monotonically_increasing_id().alias("cid"), "first.*")
    classes = scratch.table(classes, "classes")
    every = [F.struct(F.lit(p * (1 << radius + 1) + t).alias("band"), F.get("prints", F.lit(p)).bitwiseAND(F.lit(m)).alias("key")) for p in range(PRINTS) for t, m in enumerate(masks(radius, p + 1))]
    keys = classes.where("size(prints) > 0").select("cid", F.explode(F.array(*every)).alias("x")).select("cid", "x.*")

    def sets_of(cids: DataFrame) -> DataFrame:
        wanted = classes.join(cids.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("doc_id").alias("wanted"), F.col("sha").alias("own"))
        found = rows.join(wanted, F.expr("doc_id <=> wanted and sha = own")).select("cid", "text").mapInArrow(_whole_sets, "cid long, shingles binary")
        return found.dropDuplicates(["cid"])

    joined = jaccard.links(keys, sets_of)
    return classes.join(joined, F.col("cid") == F.col("node"), "left").select(F.coalesce("component", "cid").alias("component"), "doc_id", "n", "sha")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of similar_classes() one row, with all columns: the one of the smallest doc_id (null last), there the longest, then by hash.

    The row is found again by id and text, so that rows without an id, or with one id and different texts, go by their own
    components. Texts without words are one class.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", "n", "sha")).alias("first")
    stay = similar_classes(docs, id_col=id_col, text_col=text_col).groupBy("component").agg(first).select(F.col("first.doc_id").alias("__stay"), F.col("first.sha").alias("__own"))
    key = {"__id": F.col(id_col).cast("long"), "__sha": F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)}
    rows = docs.withColumns(key).alias("r").join(stay.alias("s"), F.expr("r.__id <=> s.__stay and r.__sha = s.__own"), "left_semi")
    one = Window.partitionBy("__id", "__sha").orderBy(F.col(text_col).isNull())
    return rows.withColumn("__no", F.row_number().over(one)).where("__no = 1").select(*docs.columns)


def covered(radius: int = RADIUS, seed: int = 1) -> bool:
    """Whether each set of radius positions is hidden by some mask: the guarantee, checked for all of them."""
    kept = [m % (1 << 64) for m in masks(radius, seed)]
    return all(any(not any(m >> i & 1 for i in places) for m in kept) for places in combinations(range(64), radius))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
