"""Byte-level BPE with the tiktoken library and a local rank file.

Null text counts as empty (no tokens); an empty table gives an empty result. Special tokens are never
made: their strings are ordinary text. Each row stands alone, so nulls, repeated ids and extra columns
need no care; only the id and the text column are read.

Long texts are cut before they are encoded, at places where no match of the pattern can cross: before a
lone space between two letters, or else where a match of the pattern ends that isn't white space, as what a
match of white space takes depends on the character after it.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = 1 << 18
SAFE = regex.compile(r"(?<=\p{L})(?= \p{L})")


class Codec:
    """Encodes whole texts to ids and ids to bytes."""

    def __init__(self, ranks_path: str, pattern: str = public_tokenizers.PATTERN, long: int = LONG):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: b"%d" % rank for token, rank in ranks.items()}
        self.pattern, self.long = regex.compile(pattern), long

    def pieces(self, text: str):
        """Cuts that no match crosses; together they are the text."""
        at = 0
        while len(text) - at > self.long:
            found = SAFE.search(text, at + self.long // 2, at + self.long)
            cut = found.start() if found else self._walk(text, at)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _walk(self, text: str, at: int) -> int:
        """Where the first match ends that begins half a piece after at or later and isn't white space; all matches from at are walked."""
        cut = at
        while cut < len(text):
            start, cut = cut, self.pattern.match(text, cut).end()
            if cut >= at + self.long // 2 and not text[start:cut].isspace():
                break
        return cut

    def encode(self, text: str | None) -> list[int]:
        if len(text or "") <= self.long:
            return self.bpe.encode_ordinary(text or "")
        return [i for piece in self.pieces(text) for i in self.bpe.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(ranks_path: str) -> Codec:
    """One for each Python worker."""
    return Codec(ranks_path)


def encode(docs: DataFrame, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batches):
        c = codec(ranks_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids are no bytes. Bytes may cut a character where ids were cut."""

    def run(batches):
        c = codec(ranks_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or []) for i in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass that returns digests, so that ids needn't leave the worker."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        c = codec(ranks_path)
        for b in batches:
            out: list[list] = [[], [], []]
            for text in b.column(1):
                ids = c.encode(text.as_py())
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(b",".join(map(c.names.__getitem__, ids))).hexdigest())
                out[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
