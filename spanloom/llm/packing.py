"""Packs tokenised documents into sequences by vector best-fit.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces are
placed longest first; among the bins that can take a piece under every constraint, the one wins whose weighted residual
norm (or weighted dot-product with the piece) is best, and a new bin is opened only if none can.

Pieces are dealt into groups of about GROUP by a hash, and each group is packed in one task. A group is a random sample
of the lengths, so that it costs about one bin that isn't full, and its size doesn't grow with the corpus.

Null text counts as empty: one piece, the end id alone. Only documents of more than the token capacity are cut. Repeated
rows and ids are packed as they come; an empty table gives an empty result; only the id and text column are read.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from operator import add

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core: threads of the tokenizer would only wait for each other

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import scratch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
END_ID = 1
GROUP = 30_000
WEIGHTS = (1.0, 8.0, 0.5)
CACHED, LONG_PART, SHORT, TEXTS = 500_000, 1000, 8, 256
#: The vocabulary's own pre-tokenizer, and parts that neither its normaliser nor case changes cut otherwise.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LATIN = regex.compile(r"[\x00-\x7E\xA0-\u012F\u0131-\u024F]*")
PLAIN = regex.compile(r"[\x21-\x7E\u00A1-\u012F\u0131-\u024F]+")


class WordCoder:
    """Ids as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its parts between spaces and
    line ends; and those of a part are those of its pieces, the matches of SPLIT, each of which ends with the one token of it that
    has the mark for a word's end. Parts and pieces met before are looked up, new pieces of many texts are encoded in one
    call. Only parts of plain Latin characters, which normalisation leaves alone, are cut into pieces. When the known ones are too
    many they become the older ones, from which those that come up again are taken over.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        tokens = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            return self._each(pieces)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[s:e] for s, e in zip(at, at[1:])]

    def _recalled(self, parts: set[str]) -> set[str]:
        """Moves what older knows to the known ones; returns the others."""
        again = self.older.keys() & parts
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        return parts - again

    def _learn(self, parts: set[str]) -> None:
        """Adds the parts to the known ones. Most are a word, or a word and a mark; only the others are searched for pieces."""
        known, pieces, other, cut = self.known, set(), [], {}
        parts = self._recalled(parts)
        marked, words, marks = [], [], []
        for p in parts:
            if not (p.isprintable() if p.isascii() else PLAIN.fullmatch(p)):
                other.append(p)
                continue
            low = p.lower()
            if low.isalpha():
                if low == p:
                    pieces.add(p)
                    continue
                cut[p] = [low]
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                marked.append(p)
                words.append(low[:-1])
                marks.append(low[-1])
                continue
            else:
                cut[p] = SPLIT.findall(low)
        pieces.update(words, marks, *cut.values())
        new = list(self._recalled(pieces.difference(known)))
        known.update(zip(new, self._encode(new) if new else ()))
        known.update(zip(marked, map(add, map(known.__getitem__, words), map(known.__getitem__, marks))))
        for p, own in cut.items():
            known[p] = b"".join(map(known.__getitem__, own))
        known.update(zip(other, self._each(other) if other else ()))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        known = self.known
        cut = [(t.lower() if t.isascii() or LATIN.fullmatch(t) else t).replace("\n", " ").split(" ") for t in texts]
        new = set().union(*cut).difference(known)
        self._learn(new)
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        if max(map(len, new), default=0) > LONG_PART:  # these would make the cache large
            self.forget()
        elif len(known) > CACHED:
            self.known, self.older = {"": b""}, known
        return out

    def forget(self) -> None:
        """Frees the memory for what runs next in this worker; short words, which come again and again, stay."""
        short = {p: ids for p, ids in self.known.items() if len(p) <= SHORT}
        self.known, self.older = short if len(short) <= CACHED // 4 else {"": b""}, {}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): a document's ids and END_ID, cut where they exceed the capacity."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        c, end = coder(vocabulary), END_ID.to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for few in (b.slice(i, TEXTS) for i in range(0, len(b), TEXTS)):
                for key, ids in zip(few.column(0).to_pylist(), c.encode_all([t or "" for t in few.column(1).to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)
        c.forget()

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, most_docs: int = CAPACITY, most_cost: int = CAPACITY**2, weights=WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Any piece fits an empty bin's tokens; one dearer than most_cost has a bin of its own.

    Equal pieces are placed in input order, and of equal bins the oldest wins.
    """
    limits = np.array([capacity, most_docs, most_cost], float)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    smallest = int(lengths.min()) if len(lengths) else 0
    left = np.empty((1024, 3))  # of open bins, whose numbers are in named
    named = np.empty(1024, np.int64)
    n = opened = 0
    w = np.array(weights)
    for i in order:
        size = int(lengths[i])
        need = np.array([size, 1, size * size], float)
        fits = np.flatnonzero((left[:n, 0] >= need[0]) & (left[:n, 1] >= need[1]) & (left[:n, 2] >= need[2]))
        if len(fits):
            if by == "norm":
                score = (((left[fits] - need) / limits) ** 2) @ w
            else:
                score = -((left[fits] / limits) * (need / limits)) @ w
            k = fits[np.argmin(score)]
        else:
            if n == len(left):
                left, named = np.concatenate([left, np.empty_like(left)]), np.concatenate([named, np.empty_like(named)])
            k = n
            left[k], named[k] = limits, opened
            n, opened = n + 1, opened + 1
        bins[i], offsets[i] = named[k], capacity - left[k, 0]
        left[k] -= need
        if left[k, 0] < smallest or left[k, 1] < 1 or left[k, 2] < smallest * smallest:  # full: keep the others in order of age
            left[k : n - 1], named[k : n - 1] = left[k + 1 : n].copy(), named[k + 1 : n].copy()
            n -= 1
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, most_docs: int = CAPACITY, most_cost: int = CAPACITY**2, group: int = GROUP, by: str = "norm") -> DataFrame:
    """cut: rows of pieces() without ids, with row_no, written out. Adds sequence_id and offset."""
    groups = max(1, cut.count() // group)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number = rows["_group"].iloc[0]
        rows = rows.sort_values(["length", "row_no"], ascending=[False, True], kind="stable").drop(columns=["_group", "row_no"])
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, most_docs, most_cost, by=by)
        return rows.assign(sequence_id=(int(number) << 32) + bins, offset=offsets)

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("row_no"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, schema)


def best_fit_packing(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    cut = pieces(docs, vocabulary, id_col=id_col, text_col=text_col).withColumn("row_no", F.monotonically_increasing_id())
    return pack(scratch.table(cut, "pieces"))


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
