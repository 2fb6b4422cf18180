"""Links sets of an exact Jaccard similarity of SIMILAR or more among those that share a key.

A class is a set with a number (cid); a bucket is the classes that share one key of one band. The links found connect just
what all similar pairs within the buckets would connect, whatever a bucket's size:

1. In each bucket all classes are compared with its least one. Links of many buckets are the same pair, which is checked once.
2. What these links connect is one component. Buckets of three or more classes in several components are left.
3. There the components are joined to spanning forests: sets of one component aren't compared with each other.

No task holds more than about BUCKET sets. The least class of a large bucket is copied, one copy for about BUCKET others. In step 3
large buckets are split without loss: the 0.2 n + 1 shingles of a set of n that are rarest in the bucket meet those of every
set as similar, so classes are dealt by them; those that a very common shingle keeps together are dealt by length, and then by pairs
of blocks, of which those within the bucket's largest component are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components

SIMILAR = 0.8
BUCKET = 1024


def similar_enough(both, a, b, similar: float = SIMILAR):
    """Whether sets of a and b elements, both of them shared, are similar enough."""
    return both >= similar * (a + b - both) - 1e-9


def prefix_length(n: int, similar: float = SIMILAR) -> int:
    """Of a set of n in any order common to all sets: any set as similar has one of its first so many among its own."""
    return n - math.ceil(similar * n - 1e-9) + 1


def spanning(ids: list[int], sets: list[np.ndarray], joined: list[int] | None = None, similar: float = SIMILAR):
    """Edges that connect what all pairs of that similarity would connect; those with one number in joined are connected already."""
    joined = list(range(len(ids))) if joined is None else joined
    groups: dict[int, list[int]] = {}
    for i, g in enumerate(joined):
        groups.setdefault(g, []).append(i)
    if len(groups) < 2:
        return
    sizes = np.array([len(s) for s in sets], np.int64)
    elements, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = lambda i: codes[ends[i] - sizes[i] : ends[i]]
    mark = np.zeros(len(elements), bool)
    order = sorted(groups.values(), key=len)  # the largest last: its sets are heads only for what is left then
    left = np.concatenate([np.array(g) for g in order])
    while len(left):
        group = groups[joined[left[0]]]
        tree = list(group)
        left = left[~np.isin(left, group)]
        while tree and len(left):
            head = tree.pop()
            fit = left[(sizes[left] >= similar * sizes[head] - 1e-9) & (sizes[head] >= similar * sizes[left] - 1e-9)]
            if not len(fit):
                continue
            mark[own(head)] = True
            every = np.concatenate([own(i) for i in fit])
            both = np.add.reduceat(mark[every], np.concatenate([[0], np.cumsum(sizes[fit])[:-1]]), dtype=np.int64)
            mark[own(head)] = False
            for i in fit[similar_enough(both, sizes[head], sizes[fit], similar)].tolist():
                if i in left:  # else its group came with another of these
                    yield ids[head], ids[i]
                    tree += groups[joined[i]]
                    left = left[~np.isin(left, groups[joined[i]])]


def _edges(edges: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*edges) if edges else [[], []])], ["u", "v"])


def _check(batches):
    """Rows (u, v, set of u, set of v) to those that are similar."""
    for b in batches:
        edges = []
        for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            if similar_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                edges.append((u, v))
        yield _edges(edges)


def _forests(batches):
    """Rows (band, key, band2, key2, cid, component, shingles) sorted by bucket to edges."""
    last, ids, sets, joined = None, [], [], []
    for b in batches:
        edges = []
        for key, cid, component, s in zip(zip(*(b.column(i).to_pylist() for i in range(4))), b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6)):
            if key != last:
                edges += spanning(ids, sets, joined)
                last, ids, sets, joined = key, [], [], []
            ids.append(cid)
            joined.append(component)
            sets.append(np.frombuffer(s.as_py(), np.uint64))
        yield _edges(edges)
    yield _edges(list(spanning(ids, sets, joined)))


def _shingles(batches):
    """Rows (band, key, cid, component, shingles) to one row a shingle, with the set's length group and prefix length."""
    for b in batches:
        sets = [np.frombuffer(x.as_py(), np.uint64).view(np.int64) for x in b.column(4)]
        sizes = np.array([len(x) for x in sets], np.int64)
        # sets as similar have sizes within a factor of 1.25, so groups are equal or next to each other
        groups = [int(math.log(n) / math.log(1.2501)) for n in sizes.tolist()]
        more = [np.repeat(np.array(x, np.int64), sizes) for x in (groups, [prefix_length(n) for n in sizes.tolist()])]
        at = pa.array(np.repeat(np.arange(len(sets)), sizes))
        shingle = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(4)), *map(pa.array, more), pa.array(shingle)], ["band", "key", "cid", "component", "size", "prefix", "shingle"])


def _split(hot: DataFrame, sets: DataFrame, bucket: int) -> DataFrame:
    """Rows (band, key, cid, component) of large buckets to such rows with band2 and key2: each similar pair of two components shares one of these."""
    place = ["band", "key"]
    largest = hot.groupBy(*place, "component").agg(F.count("*").alias("n")).groupBy(*place).agg(F.max_by("component", F.struct("n", "component")).alias("hub"))
    rows = hot.join(sets, "cid").select(*place, "cid", "component", "shingles")
    rows = scratch.table(rows.mapInArrow(_shingles, "band int, key long, cid long, component long, size long, prefix long, shingle long"), "shingles")
    one = [*place, "shingle"]
    rarest = Window.partitionBy(*place, "cid").orderBy("n", "shingle")
    rows = rows.join(rows.groupBy(*one).agg(F.count("*").alias("n")), one).withColumn("rank", F.row_number().over(rarest))
    rows = rows.where("rank <= prefix and n > 1").select(*one, "cid", "component", "size").join(largest, place)
    rows = scratch.table(rows.withColumn("hub", F.col("component") == F.col("hub")), "prefixes")
    mixed = rows.groupBy(*one).agg(F.count("*").alias("n"), (F.min("component") < F.max("component")).alias("mixed")).where("mixed")
    rows = rows.join(mixed, one)
    small = rows.where(F.col("n") <= bucket).select(*place, F.lit(-2).alias("band2"), F.col("shingle").alias("key2"), "cid", "component")
    rest = rows.where(F.col("n") > bucket).select(*place, "cid", "component", "size", "hub").distinct()
    rest = rest.select(*place, "cid", "component", "hub", F.explode(F.array("size", F.col("size") + 1).cast("array<int>")).alias("band2"))
    half = [*place, "band2"]
    count = lambda test: F.ceil(F.count_if(test) * 2 / bucket)
    blocks = rest.groupBy(*half).agg(count(F.col("hub")).alias("hubs"), count(~F.col("hub")).alias("others")).where("others > 0")
    # blocks 0 to others-1 are of the smaller components, those of the hub follow; each block meets those of the smaller ones
    rest = rest.join(blocks, half).withColumn("own", F.when(F.col("hub"), F.col("others") + F.pmod(F.xxhash64("cid"), F.greatest("hubs", F.lit(1)))).otherwise(F.pmod(F.xxhash64("cid"), "others")))
    upto = F.when(F.col("hub"), F.col("others") - 1).otherwise(F.col("others") + F.col("hubs") - 1)
    rest = rest.select(*half, "cid", "component", "own", "others", "hubs", F.explode(F.sequence(F.lit(0).cast("long"), upto)).alias("other"))
    rest = rest.where("own <> other or (others = 1 and hubs = 0)")
    pair = F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")
    return small.unionByName(rest.select(*half, pair.alias("key2"), "cid", "component"))


def links(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], bucket: int | None = None) -> DataFrame:
    """(node, component) of all classes with a similar one; component is the least cid of those connected.

    keys: (cid, band int, key long), each once. They are shuffled and sorted once: nearly all are alone in their bucket, so that counting
    them first would gain nothing. sets_of takes a DataFrame with cid to (cid, shingles): sorted
    unsigned longs as bytes, none of them empty.
    """
    spark, bucket = keys.sparkSession, bucket or BUCKET
    place = ["band", "key"]
    whole = Window.partitionBy(*place)
    dealt = scratch.table(keys.withColumn("n", F.count("*").over(whole)).withColumn("least", F.min("cid").over(whole)).where("n > 1"), "buckets")
    sets = scratch.table(sets_of(dealt), "sets")
    copies = lambda n: F.ceil(n / bucket).cast("long")
    pairs = dealt.where("cid <> least").groupBy(F.col("least").alias("u"), F.col("cid").alias("v")).agg(F.max("n").alias("n"))
    pairs = pairs.select("u", "v", F.pmod(F.xxhash64("v"), copies(F.col("n"))).alias("copy"))
    heads = dealt.groupBy(F.col("least").alias("u")).agg(copies(F.max("n")).alias("copies"))
    heads = heads.join(sets.select(F.col("cid").alias("u"), F.col("shingles").alias("x")), "u").select("u", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    pairs = pairs.join(heads, ["u", "copy"]).join(sets.select(F.col("cid").alias("v"), F.col("shingles").alias("y")), "v")
    found = scratch.table(pairs.select("u", "v", "x", "y").mapInArrow(_check, "u long, v long"), "links")
    joined = connected_components(found)
    named = dealt.where("n > 2").join(joined, F.col("cid") == F.col("node"), "left").select(*place, "n", "cid", F.coalesce("component", "cid").alias("component"))
    open_ = named.groupBy(*place).agg((F.min("component") < F.max("component")).alias("open"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("sum"), F.max("n").alias("n")).where("open")
    open_ = open_.groupBy("n", "sum").agg(F.min(F.struct(*place)).alias("one")).select("one.*")  # of buckets of the same classes one is enough
    named = scratch.table(named.join(open_, place), "open")
    rest = named.where(F.col("n") <= bucket).select(*place, F.lit(-1).alias("band2"), F.lit(0).cast("long").alias("key2"), "cid", "component")
    hot = named.where(F.col("n") > bucket).select(*place, "cid", "component")
    if hot.head(1):
        rest = rest.unionByName(_split(hot, sets, bucket))
    four = [*place, "band2", "key2"]
    rest = rest.join(sets, "cid").select(*four, "cid", "component", "shingles").repartition(scratch.partitions(spark), *four).sortWithinPartitions(*four)
    more = scratch.table(rest.mapInArrow(_forests, "u long, v long"), "links")
    if more.head(1):
        joined = connected_components(found.unionByName(more))
    for done in (dealt, sets, found, named, more):
        scratch.drop(done)
    return joined
