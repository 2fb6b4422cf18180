"""Suffix-array dedup of long repeated byte strings, by common-prefix interval trees.

A sparse enhanced suffix array. Anchors are minimisers: of the hashed KGRAM-byte strings that start in a window of MATCH
bytes, the least one (the first of equals) owns the window, so equal windows have equal owners at equal places. An anchor's
segment is all the bytes of the windows that it owns. Anchors whose k-gram occurs once are dropped; the others are buckets of
suffixes that share their first KGRAM bytes, which are disjoint subtrees of the suffix tree.

Equal segments of a bucket, told by 128 bits of BLAKE2b, are one leaf with a count before any text moves. In a bucket with different segments the suffixes
are sorted, and a stack scan over the common prefixes of neighbours gives the LCP intervals. In each interval the left
contexts are scanned in the same way: an interval of left contexts whose rows also differ to the right is a maximal repeat
group, with all its occurrences. A window is a repeat if a group of two or more spans it.

A bucket of more than HOT different segments (a passage in very many contexts) isn't gathered. Its windows are cut into a
quarter as many a segment, keyed by the longer string these have in common, and dealt anew; after four rounds a key is one window,
and a count decides. Leaves are told apart by a cryptographic digest, all other decisions compare bytes. Rows of a hot k-gram or
leaf are dealt by document too, so that no task gets them all.

repeat_groups() gives the groups with all their occurrences, removals() and without_repeats() what is left of the texts. Very long
texts are read by chunks; a document's bytes are held in one task.

A passage of 50 words is shorter than 400 bytes as a rule. The query op2 also gives the text without such passages, found by strings of 200
bytes. A string of 400 bytes that repeats lies in one run of repeated strings of 200, so only those runs are sought for it.

Null text counts as empty. Matches never cross rows. Rows that repeat an id or a text are rows of their own, and repeat each
other. An empty table gives an empty result. Only the id and text column are read, so others may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

MATCH = 400
KGRAM = 128
HOT = 1024
CHUNK = 1 << 19
PLACE = (1 << 20) - 1
#: Bytes, k-gram and words of a repeated passage; one of so many words with fewer bytes isn't prose.
PASSAGE = (200, 64, 50)
LEAST = -(2**63)
LEAF = ("k0", "s0", "i0")
SEGMENT = "kh long, sh long, si long, n long, rd long, rk long, at long, seg binary"
_random = np.random.default_rng(20240229)
BYTE = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def kgram_hashes(data: np.ndarray, k: int = KGRAM) -> np.ndarray:
    """A hash of each string of k bytes (a power of two), by doubling."""
    h, size, step = BYTE[data], 1, 0
    while size < k:
        h = h[:-size] * ODD[step] + h[size:]
        h ^= h >> np.uint64(29)
        size, step = 2 * size, step + 1
    return h * ODD[60]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, size = x, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (width - size)], m[width - size :]) if width > size else m


def anchors_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, match: int = MATCH, k: int = KGRAM, chunk: int = CHUNK):
    """Yields arrays (document number, k-gram hash, two halves of the segment's digest, place in the document, lo, hi) of the texts data[starts:ends].

    An anchor at place p owns the windows that start at p-hi to p-lo.
    """
    width = match - k + 1
    for c in range(0, max(0, len(data) - match + 1), chunk):
        x = data[c : c + chunk + match - 1]
        owned = np.zeros(len(x) - match + 1, bool)
        first = np.searchsorted(ends, c, "right")
        for d in range(first, np.searchsorted(starts, c + len(owned), "left")):
            owned[max(0, starts[d] - c) : max(0, ends[d] - match + 1 - c)] = True
        at = np.flatnonzero(owned)
        if not len(at):
            continue
        h = kgram_hashes(x, k)
        owner = (sliding_min(h & np.uint64(~PLACE & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64), width)[at] & np.uint64(PLACE)).astype(np.int64)
        cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        s0, s1 = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts - 1, [len(at) - 1]])]
        a = owner[np.concatenate([[0], cuts])]
        raw = x.tobytes()
        digests = b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(s0.tolist(), (s1 + match).tolist())])
        halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
        doc = np.searchsorted(starts, a + c, "right") - 1
        yield doc, h[a].view(np.int64), halves[:, 0], halves[:, 1], a + c - starts[doc], a - s1, a - s0


def _anchor_rows(match: int, k: int):
    names = ["kh", "sh", "si", "rd", "rk", "at"]

    def run(batches):
        for b in batches:
            text = b.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            if not len(text) or offsets[-1] == offsets[0]:
                continue
            data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            # empty texts would share their start with the next one
            row = np.flatnonzero(offsets[1:] > offsets[:-1])
            starts, ends = offsets[:-1][row] - offsets[0], offsets[1:][row] - offsets[0]
            begin = np.zeros(len(row), np.int64)
            if b.num_columns > 3:  # only these runs of each text
                parts = [(i, x["s"], x["e"]) for i, runs in enumerate(b.column(3).to_pylist()) for x in runs if x["e"] - x["s"] >= match]
                if not parts:
                    continue
                row, begin, until = np.array(parts, np.int64).T
                first = offsets[row] - offsets[0]
                data = np.concatenate([data[s:e] for s, e in zip((first + begin).tolist(), (first + until).tolist())])
                ends = np.cumsum(until - begin)
                starts = ends - (until - begin)
            rd, rk = (b.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            for doc, kh, sh, si, place, lo, hi in anchors_of(data, starts, ends, match, k):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kh, sh, si, rd[doc], rk[doc], place + begin[doc] << 20 | lo << 10 | hi)], names)

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    same, differs = 0, n
    while differs - same > 1:
        mid = (same + differs) // 2
        if a[same:mid] == b[same:mid]:
            same = mid
        else:
            differs = mid
    return same


def intervals(lcps: list[int]):
    """Stack scan: (depth, first row, last row) of each LCP interval. lcps[i] is of rows i and i+1."""
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*lcps, -1]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            yield depth, first, i
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, first))


def maximal_repeats(rows: list[tuple[bytes, bytes]], match: int = MATCH):
    """Groups of rows (left context reversed, suffix): yields (left length, right length, row numbers).

    Each group is all rows that share a string of match bytes or more round the anchor which can be extended neither to the left nor
    to the right without losing rows.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i][1])
    lcps = [common(rows[i][1], rows[j][1]) for i, j in zip(order, order[1:])]
    for depth, first, last in intervals(lcps):
        ranks = sorted(range(first, last + 1), key=lambda r: rows[order[r]][0])
        lefts = [common(rows[order[r]][0], rows[order[s]][0]) for r, s in zip(ranks, ranks[1:])]
        for left, x, y in intervals(lefts):
            if left + depth >= match:
                own = ranks[x : y + 1]
                if min(lcps[min(own) : max(own)]) == depth:  # else all of it goes on to the right: a deeper interval has it
                    yield left, depth, [order[r] for r in own]


def _by_bucket(decide, names: list[str]):
    """Batches of segments sorted by kh to the rows that decide finds in each bucket of two or more."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*dict.fromkeys(rows)) if rows else [[]] * len(names))], names)

    def found(bucket: list[tuple]):
        # left contexts, reversed, and suffixes
        parts = [(seg[: at & 1023][::-1], seg[at & 1023 :]) for *_, at, seg in bucket]
        return decide(bucket, parts) if len(bucket) > 1 else ()

    def run(batches):
        bucket: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if bucket and row[0] != bucket[0][0]:
                    out += found(bucket)
                    bucket = []
                bucket.append(row)
            if out:
                yield batch(out)
        yield batch(list(found(bucket)))

    return run


def _spans_of(match: int):
    """Spans (rd, rk, s, e): bytes of rows with n = 1 that repeat."""

    def decide(bucket: list[tuple], parts: list[tuple[bytes, bytes]]):
        own: dict[int, list[tuple[int, int]]] = {}
        for left, right, members in maximal_repeats(parts, match):
            for m in members:
                n, _, _, at = bucket[m][3:7]
                lo, hi = max(at >> 10 & 1023, match - right), min(at & 1023, left)
                if n == 1 and lo <= hi:
                    own.setdefault(m, []).append(((at >> 20) - hi, (at >> 20) - lo + match))
        for m, spans in own.items():
            for s, e in merged(spans):
                yield *bucket[m][4:6], s, e

    return decide


def _groups_of(match: int):
    """Members (grp, kh, sh, si, back, ahead) of maximal repeat groups: a leaf, and how far the group's string goes either way."""

    def decide(bucket: list[tuple], parts: list[tuple[bytes, bytes]]):
        whole = set()
        for k, (left, right, members) in enumerate(maximal_repeats(parts, match)):
            for m in members:
                if (left, right) == (len(parts[m][0]), len(parts[m][1])):
                    whole.add(m)
                yield _hash(b"%d %d" % (bucket[m][0], k)), *bucket[m][:3], left, right
        for m, (kh, sh, si, n, *_) in enumerate(bucket):
            if n > 1 and m not in whole:  # a leaf of many rows that no other one holds
                yield _hash(b"%d leaf %d" % (kh, m)), kh, sh, si, len(parts[m][0]), len(parts[m][1])

    return decide


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _finer(match: int, step: int):
    """Rows of segments to such rows whose windows are cut into blocks of step offsets, with keys of their own, and their leaf."""

    def run(batches):
        for b in batches:
            out = []
            for kh, sh, si, n, rd, rk, at, seg in zip(*(c.to_pylist() for c in b.columns)):
                place, lo, hi = at >> 20, at >> 10 & 1023, at & 1023
                for j in range(lo // step, hi // step + 1):
                    low, high = max(lo, j * step), min(hi, j * step + step - 1)
                    core = seg[hi - j * step : hi + match - (j * step + step - 1)]
                    part = seg[hi - high : hi - low + match]
                    own = hashlib.blake2b(b"%d %d " % (low, high) + part, digest_size=16).digest()
                    halves = (int.from_bytes(x, "little", signed=True) for x in (own[:8], own[8:]))
                    out.append((_hash(b"%d %d %d " % (kh, j, step), core), *halves, n, rd, rk, place << 20 | low << 10 | high, part, kh, sh, si))
            kinds = [pa.int64()] * 7 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 11, kinds)], ["kh", "sh", "si", "n", "rd", "rk", "at", "seg", *LEAF])

    return run


def _segments(match: int):
    """Documents with their list of anchors to rows (kh, sh, si, n, rd, rk, at, seg)."""

    def run(batches):
        for b in batches:
            out = []
            for rd, rk, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
                for w in wanted:
                    at = w["at"]
                    place = at >> 20
                    out.append((w["kh"], w["sh"], w["si"], w["n"], rd, rk, at, text[place - (at & 1023) : place - (at >> 10 & 1023) + match]))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 8, kinds)], ["kh", "sh", "si", "n", "rd", "rk", "at", "seg"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rd, rk, text binary): rd is the id or LEAST, and rd with rk tells rows of different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("rd"), F.xxhash64(text).alias("rk"), text.cast("binary").alias("text"))


def _shared(docs: DataFrame, match: int, k: int, id_col: str, text_col: str, within: DataFrame | None = None) -> DataFrame:
    """The anchors whose k-gram occurs more than once; within: (rd, rk, spans), the only runs of bytes that are looked at."""
    texts = keyed(docs, id_col, text_col)
    if within is not None:
        texts = texts.join(within, ["rd", "rk"]).select("rd", "rk", "text", "spans")
    anchors = scratch.table(texts.mapInArrow(_anchor_rows(match, k), "kh long, sh long, si long, rd long, rk long, at long"), "anchors")
    # a table of its own, so that the join's sides are plain exchanges and a hot k-gram's rows can be split
    kgrams = scratch.table(anchors.groupBy("kh").count().where("count > 1").select("kh"), "kgrams")
    shared = scratch.table(anchors.join(kgrams, "kh", "left_semi"), "shared")
    scratch.drop(anchors)
    scratch.drop(kgrams)
    return shared


def _bounds():
    """lo and hi of an anchor."""
    return F.shiftright("at", 10).bitwiseAND(F.lit(1023)), F.col("at").bitwiseAND(F.lit(1023))


def _rounds(shared: DataFrame, texts: DataFrame, match: int, hot: int, groups: bool) -> DataFrame:
    """Spans (rd, rk, s, e), or the members (grp, kh, sh, si, back, ahead) of groups, of leaves of shared."""
    n, key, (lo, hi), place = scratch.partitions(shared.sparkSession), ["kh", "sh", "si"], _bounds(), F.shiftright("at", 20)
    found, result, finer = shared.withColumn("n", F.lit(1).cast("long")), None, []
    steps = [x for x in (64, 16, 4, 1) if 4 * x <= match]  # blocks of offsets keep three quarters of a window in common
    while True:
        text = ["seg"] if finer else []
        leaves = found.groupBy(*key).agg(F.sum("n").alias("n"), scratch.salts("rd", "at").alias("bits"), F.min(F.struct("rd", "rk", "at", *text)).alias("one"))
        leaves = scratch.table(leaves.select(*key, "n", "bits", "one.*"), "leaves")
        mixed = leaves.groupBy("kh").agg(F.count("*").alias("c"), F.count_if(F.col("n") == 1).alias("single"), scratch.salts("sh").alias("bits"))
        mixed = mixed.where("c > 1" if groups else "c > 1 and single > 0")  # where all leaves repeat, all their bytes do
        rows = leaves.drop("bits").withColumn("salt", scratch.salt("sh")).join(mixed.select("kh", "c", scratch.each_salt("bits").alias("salt")), ["kh", "salt"])
        if not finer:
            wanted = rows.groupBy("rd", "rk").agg(F.collect_list(F.struct(*key, "n", "at")).alias("wanted"))
            cut = texts.join(wanted, ["rd", "rk"]).select("rd", "rk", "text", "wanted").mapInArrow(_segments(match), SEGMENT)
            rows = scratch.table(cut, "segments")
            large = scratch.table(mixed.where(F.col("c") > hot).select("kh"), "large")
            small, large_rows = rows.join(large, "kh", "left_anti"), rows.join(large, "kh", "left_semi")
        else:
            small, large_rows = rows.where(F.col("c") <= hot), rows.where(F.col("c") > hot)
            large = mixed.where(F.col("c") > hot).select("kh")
        columns = ["kh", "sh", "si", "n", "rd", "rk", "at", "seg"]
        dealt = small.select(*columns).repartition(n, "kh").sortWithinPartitions("kh")
        if groups:
            members = leaves.where("n > 1").join(mixed.select("kh"), "kh", "left_anti").select(F.xxhash64(*key).alias("grp"), *key, hi.alias("back"), (match - lo).alias("ahead"))
            members = members.unionByName(dealt.mapInArrow(_by_bucket(_groups_of(match), ["grp", *key, "back", "ahead"]), "grp long, kh long, sh long, si long, back long, ahead long"))
            for f in reversed(finer):  # a finer leaf may hold several of the round before
                members = members.join(f.select(*key, *LEAF), key).select("grp", *[F.col(x).alias(c) for c, x in zip(key, LEAF)], "back", "ahead")
            both = members
        else:
            own = leaves.where("n > 1").select(*key, scratch.each_salt("bits").alias("salt"))
            whole = found.where("n = 1").withColumn("salt", scratch.salt("rd", "at")).join(own, [*key, "salt"], "left_semi")
            both = whole.select("rd", "rk", (place - hi).alias("s"), (place - lo + match).alias("e")).unionByName(dealt.mapInArrow(_by_bucket(_spans_of(match), ["rd", "rk", "s", "e"]), "rd long, rk long, s long, e long"))
        result = both if result is None else result.unionByName(both)
        if not steps or not large.head(1):
            return result
        found = scratch.table(large_rows.select(*columns).mapInArrow(_finer(match, steps.pop(0)), f"{SEGMENT}, k0 long, s0 long, i0 long"), "finer")
        finer.append(found)


def repeated_spans(docs: DataFrame, match: int = MATCH, k: int = KGRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", within: DataFrame | None = None) -> DataFrame:
    """(rd, rk, s, e): stretches of bytes that strings of match bytes cover which start elsewhere too; they may overlap.

    within: runs (rd, rk, spans) known to hold all such strings, of those that strings of fewer bytes cover.
    """
    return _rounds(_shared(docs, match, k, id_col, text_col, within), keyed(docs, id_col, text_col), match, hot, False)


def repeat_groups(docs: DataFrame, match: int = MATCH, k: int = KGRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(grp, doc_id, rk, s, e): the maximal repeat groups, each with all its occurrences, of which the bytes from s to e are equal.

    rk, a hash of the text, tells rows of one id apart. A group is of one anchor: a repeat that many anchors' segments cover is as
    many groups, each as wide as its segments. In a bucket of more than hot leaves a group is maximal within its block of windows.
    """
    shared, key = _shared(docs, match, k, id_col, text_col), ["kh", "sh", "si"]
    members = scratch.table(_rounds(shared, keyed(docs, id_col, text_col), match, hot, True).distinct(), "members")
    rows = shared.withColumn("salt", scratch.salt("rd", "at"))
    members = members.join(rows.groupBy(*key).agg(scratch.salts("rd", "at").alias("bits")), key).withColumn("salt", scratch.each_salt("bits"))
    place = F.shiftright("at", 20)
    return rows.join(members, [*key, "salt"]).select("grp", F.nullif("rd", F.lit(LEAST)).alias("doc_id"), "rk", (place - F.col("back")).alias("s"), (place + F.col("ahead")).alias("e")).distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[s:e] for s, e in zip(cuts[::2], cuts[1::2]))


def _by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("rd", "rk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _merged_runs(spans: DataFrame) -> DataFrame:
    """(rd, rk, spans): the maximal runs of each document's spans."""
    schema = "rd long, rk long, spans array<struct<s:long,e:long>>"
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches):
        for b in batches:
            runs = [[{"s": s, "e": e} for s, e in merged([(x["s"], x["e"]) for x in spans])] for spans in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, kind)], ["rd", "rk", "spans"])

    return _by_document(spans).mapInArrow(run, schema)


def removals(
    docs: DataFrame, match: int = MATCH, k: int = KGRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", passage: tuple[int, int, int] | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    passage: (match, k, least_words), with fewer bytes than match. Then (text, n_passages) follow: what without_repeats() leaves by these, empty for
    null, and the number of runs that it takes away. The other columns stay what they are.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kinds = [pa.int64()] * 4 + [pa.string()]
    runs = None
    if passage:
        if passage[0] > match:
            raise ValueError("a passage's bytes are match at most")
        schema, kinds = f"{schema}, text string, n_passages long", [*kinds, pa.string(), pa.int64()]
        short = repeated_spans(docs, *passage[:2], hot, id_col, text_col)
        runs = scratch.table(_merged_runs(short), "runs")
        scratch.drop(short, docs)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for rd, _, text, spans, *more in zip(*(c.to_pylist() for c in b.columns)):
                runs = merged([(x["s"], x["e"]) for x in spans or ()])
                kept = kept_bytes(text, runs)
                row = (None if rd == LEAST else rd, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                for found in more:
                    gone = long_runs(text, [(x["s"], x["e"]) for x in found or ()], passage[2])
                    row += (kept_bytes(text, gone).decode(errors="ignore"), len(gone))
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    within = None if runs is None else runs.where(F.exists("spans", lambda x: x["e"] - x["s"] >= match))
    spans = _by_document(repeated_spans(docs, match, k, hot, id_col, text_col, within))
    rows = keyed(docs, id_col, text_col).join(spans, ["rd", "rk"], "left")
    if runs is not None:
        rows = rows.join(runs.withColumnRenamed("spans", "runs"), ["rd", "rk"], "left")
    return rows.select("rd", "rk", "text", "spans", *(["runs"] if passage else [])).mapInArrow(run, schema)


def long_runs(text: bytes, runs: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """The runs that hold least_words words or parts of words."""
    return [(s, e) for s, e in runs if len(text[s:e].split()) >= least_words]


def without_repeats(docs: DataFrame, match: int = MATCH, k: int = KGRAM, id_col: str = "doc_id", text_col: str = "text", least_words: int = 0) -> DataFrame:
    """The rows of docs, with all their columns, without the repeated bytes. A character that loses a byte loses all; null text stays null.

    Only maximal runs of repeated bytes with least_words words or more go.
    """

    def left(text, spans):
        if text is None or spans is None or not len(spans):
            return text
        raw = text.encode()
        return kept_bytes(raw, long_runs(raw, merged([(x["s"], x["e"]) for x in spans]), least_words)).decode(errors="ignore")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([left(t, x) for t, x in zip(texts, spans)], dtype=object)

    spans = _by_document(repeated_spans(docs, match, k, id_col=id_col, text_col=text_col)).select(F.col("rd").alias("__rd"), F.col("rk").alias("__rk"), F.col("spans").alias("__spans"))
    rows = docs.withColumns({"__rd": F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)), "__rk": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}).join(spans, ["__rd", "__rk"], "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(kept(F.col(text_col), F.col("__spans")))
    return rows.withColumn(text_col, text).select(*docs.columns)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE)
