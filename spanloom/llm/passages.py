"""Passages that several documents hold, wherever they lie in a text, by the minima of windows of words.

A window is WORDS words in a row, A-Z in lower case, whatever white space or line ends part them. Of the hashes of its KGRAM-word strings
the least (the first of equals) is its key, so equal windows have equal keys at equal places. An anchor is such a string with all the
windows that have it as their key; equal runs of windows of one key are a leaf. A leaf that is alone with its key is in all its documents
word by word. Of the others the windows themselves are told apart, by key and hash: 64 bits each, of 64-bit hashes of the words.

So every window that another document holds is found, and no other one: a document that repeats itself only has none. No key's rows are
gathered in a task. Fewer than WORDS words hold no window. Ids and rows are those of suffix_dedup.keyed(); rows that repeat an id and a
text are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .suffix_dedup import ODD, PLACE, sliding_min

#: A passage of 50 words holds 48 whole ones where it was put into a text in the midst of words.
WORDS, KGRAM = 48, 16
CHUNK = 1 << 18
CACHED = 300_000
LEAF = ("kh", "sh")


class WordHashes:
    """Hashes of words, kept until the table is full."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each string of KGRAM and of each of WORDS words, by doubling; WORDS is three times KGRAM."""
    grams, size, step = h, 1, 0
    while size < KGRAM:
        grams = grams[:-size] * ODD[step] + grams[size:]
        grams ^= grams >> np.uint64(29)
        size, step = 2 * size, step + 1
    n = len(h) - WORDS + 1
    windows = (grams[:n] * ODD[40] + grams[KGRAM : KGRAM + n]) * ODD[41]
    windows = (windows ^ windows >> np.uint64(29)) * ODD[42] + grams[2 * KGRAM : 2 * KGRAM + n]
    return grams * ODD[60], (windows ^ windows >> np.uint64(31)) * ODD[43]


def anchors_of(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = CHUNK):
    """Yields arrays (document number, key, hash of the run of windows, place in the document, lo, hi) of the documents h[starts:ends], none of them empty.

    An anchor at place p is the key of the windows that start at p-hi to p-lo.
    """
    low = np.uint64(PLACE)
    for c in range(0, max(0, len(h) - WORDS + 1), chunk):
        x = h[c : c + chunk + WORDS - 1]
        owned = np.zeros(len(x) - WORDS + 1, bool)
        for d in range(np.searchsorted(ends, c, "right"), np.searchsorted(starts, c + len(owned), "left")):
            owned[max(0, starts[d] - c) : max(0, ends[d] - WORDS + 1 - c)] = True
        at = np.flatnonzero(owned)
        if not len(at):
            continue
        grams, windows = window_hashes(x)
        key = (sliding_min(grams & ~low | np.arange(len(grams), dtype=np.uint64), WORDS - KGRAM + 1)[at] & low).astype(np.int64)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        s0, s1 = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts - 1, [len(at) - 1]])]
        a = key[np.concatenate([[0], cuts])]
        run = (windows[s0] * ODD[44] + windows[s1]) * ODD[45] + (s1 - s0).astype(np.uint64)  # the first and the last hold all words between
        doc = np.searchsorted(starts, a + c, "right") - 1
        yield doc, grams[a].view(np.int64), run.view(np.int64), a + c - starts[doc], a - s1, a - s0


def _anchor_rows(batches):
    words = WordHashes()
    for b in batches:
        rows, parts = [], []
        for i, text in enumerate(b.column(2)):
            own = text.as_py().lower().split()
            if len(own) >= WORDS:
                rows.append(i)
                parts.append(words.of(own))
        if not rows:
            continue
        ends = np.cumsum([len(p) for p in parts])
        starts = np.concatenate([[0], ends[:-1]])
        rd, rk = (b.column(i).to_numpy(zero_copy_only=False)[rows] for i in (0, 1))
        for doc, kh, sh, place, lo, hi in anchors_of(np.concatenate(parts), starts, ends):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kh, sh, rd[doc], rk[doc], place << 20 | lo << 10 | hi)], [*LEAF, "rd", "rk", "at"])


def _bounds():
    """lo and hi of an anchor."""
    return F.shiftright("at", 10).bitwiseAND(F.lit(1023)), F.col("at").bitwiseAND(F.lit(1023))


def _several():
    """Aggregate: whether rows are of more than one document."""
    return (F.min("rd") < F.max("rd")) | (F.min("rk") < F.max("rk"))


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(kh, sh, rd, rk, at): the anchors of keyed() texts whose key occurs more than once."""
    anchors = scratch.table(texts.mapInArrow(_anchor_rows, "kh long, sh long, rd long, rk long, at long"), "anchors")
    keys = scratch.table(anchors.groupBy("kh").count().where("count > 1").select("kh"), "kgrams")
    shared = scratch.table(anchors.join(keys, "kh", "left_semi"), "shared")
    scratch.drop(anchors)
    scratch.drop(keys)
    scratch.release(texts.sparkSession)
    return shared


def leaves_of(shared: DataFrame) -> DataFrame:
    """(kh, sh, several, bits, rd, rk, at, c): the leaves, whether in several documents, with their first row, and how many leaves their key has."""
    leaves = shared.groupBy(*LEAF).agg(_several().alias("several"), scratch.salts("rd", "at").alias("bits"), F.min(F.struct("rd", "rk", "at")).alias("one"))
    leaves = scratch.table(leaves.select(*LEAF, "several", "bits", "one.*"), "leaves")
    keys = leaves.groupBy("kh").agg(F.count("*").alias("c"), scratch.salts("sh").alias("salts")).select("kh", "c", scratch.each_salt("salts").alias("salt"))
    counted = scratch.table(leaves.withColumn("salt", scratch.salt("sh")).join(keys, ["kh", "salt"]).drop("salt"), "counted")
    scratch.drop(leaves)
    return counted


def mixed(leaves: DataFrame) -> DataFrame:
    """(rd, rk, leaves): the documents in which windows are to be read, for keys of several leaves."""
    return leaves.where("c > 1").groupBy("rd", "rk").agg(F.collect_list(F.struct(*LEAF, "several", "at")).alias("leaves"))


def windows_of(h: np.ndarray, leaves: list[dict]):
    """Yields (kh, sh, several, lo, hashes of the windows from lo on) of a document's leaves."""
    hashes = window_hashes(h)[1].view(np.int64)
    for x in leaves:
        place, lo, hi = x["at"] >> 20, x["at"] >> 10 & 1023, x["at"] & 1023
        yield x["kh"], x["sh"], x["several"], lo, hashes[place - hi : place - lo + 1][::-1].tolist()


def repeated_passages(shared: DataFrame, leaves: DataFrame, windows: DataFrame) -> DataFrame:
    """(rd, rk, first_rd, s, e): words s to e of a document, each in a window that first_rd, the least id with that window, holds too.

    windows: (kh, sh, several, rd, rk, lo, windows), as by windows_of() for the rows of mixed(). Spans may overlap.
    """
    lo, hi = _bounds()
    each = windows.select(*LEAF, "several", "rd", "rk", "lo", F.posexplode("windows").alias("i", "wh"))
    held = each.groupBy("kh", "wh").agg((_several() | F.bool_or("several")).alias("held"), F.min("rd").alias("first_rd"), scratch.salts("sh").alias("salts")).where("held")
    held = held.select("kh", "wh", "first_rd", scratch.each_salt("salts").alias("salt"))
    # a leaf's windows all hold its k-gram, so those of one document between the outermost two cover no further word
    runs = each.withColumn("salt", scratch.salt("sh")).join(held, ["kh", "wh", "salt"]).groupBy(*LEAF, "first_rd").agg(F.min(F.col("lo") + F.col("i")).alias("low"), F.max(F.col("lo") + F.col("i")).alias("high"))
    runs = runs.join(leaves.select(*LEAF, "bits"), list(LEAF)).select(*LEAF, "first_rd", "low", "high", "bits")
    whole = leaves.where("c = 1 and several").select(*LEAF, F.col("rd").alias("first_rd"), lo.alias("low"), hi.alias("high"), "bits")
    runs = runs.unionByName(whole).select(*LEAF, "first_rd", "low", "high", scratch.each_salt("bits").alias("salt"))
    place = F.shiftright("at", 20)
    rows = shared.withColumn("salt", scratch.salt("rd", "at")).join(runs, [*LEAF, "salt"])
    return rows.select("rd", "rk", "first_rd", (place - F.col("high")).alias("s"), (place - F.col("low") + WORDS).alias("e"))
