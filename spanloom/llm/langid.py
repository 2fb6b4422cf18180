"""Language ID by rank-order profiles.

A profile is the PROFILE most frequent character n-grams (n = 1 to 3, words framed by "_"), ranked. A text gets the
language whose profile has the least out-of-place distance to its own: the sum over its n-grams of how far the rank
differs, and PROFILE for an n-gram that the profile lacks. Equal counts rank by the n-gram's code points; of equal distances
the first language in alphabetical order wins.

Profiles are learned from labelled rows: of each language about SAMPLE rows at most, chosen by a hash, whole texts. The
profiles (PROFILE rows a language) are all that reaches the driver. lang_pred is "und" where a text is null or has no
letter, or where nothing was learned. Very long texts are counted whole, by blocks. Rows stand alone, so null or repeated ids
and extra columns need no care; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
SAMPLE = 3000
OTHERS = regex.compile(r"\P{L}+")
FRAME = ord("_")
BLOCK = 1 << 20
DENSE = 1 << 18


def key_of(gram: str) -> int:
    """An n-gram as a long: 21 bits for each of its characters."""
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of framed words, given as code points."""
    letters, codes = np.unique(x, return_inverse=True) if x.max() >= 1024 else (np.flatnonzero(np.bincount(x)), None)
    if codes is None:
        place = np.zeros(1024, np.int64)
        place[letters] = np.arange(len(letters))
        codes = place[x]
    a, letters = len(letters), letters.astype(np.int64)
    inner = codes[1:-1][x[1:-1] != FRAME]
    two = codes[:-1] * a + codes[1:]
    three = (two[:-1] * a + codes[2:])[x[1:-1] != FRAME]  # none that spans two words
    found = []
    for grams, size in ((inner, a), (two, a * a), (three, a**3)):
        if size <= DENSE:
            counts = np.bincount(grams)
            grams = np.flatnonzero(counts)
            counts = counts[grams]
        else:
            grams, counts = np.unique(grams, return_counts=True)
        keys = letters[grams % a]
        if size > a:
            keys = keys | letters[grams // a % a] << 21
        if size > a * a:
            keys = keys | letters[grams // (a * a)] << 42
        found.append((keys, counts))
    return np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of a text and their counts, keys in order; long texts are counted by blocks that end with a word."""
    words = OTHERS.sub("_", text.lower()).strip("_")
    keys, counts, at = [], [], 0
    while at < len(words):
        end = len(words) if len(words) - at <= BLOCK else words.find("_", at + BLOCK)
        end = len(words) if end < 0 else end
        k, c = _counted(np.frombuffer(f"_{words[at:end]}_".encode("utf-32-le", "surrogatepass"), np.uint32))
        keys.append(k)
        counts.append(c)
        at = end + 1
    if len(keys) <= 1:
        return (keys[0], counts[0]) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    unique, where = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def top(text: str) -> np.ndarray:
    """Keys of the text's PROFILE most frequent n-grams, in order of rank."""
    keys, counts = gram_counts(text)
    if len(keys) > PROFILE:
        often = counts >= np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keys, counts = keys[often], counts[often]
    return keys[np.lexsort((keys, -counts))][:PROFILE]


class Ranker:
    """Distances of texts to the profiles, which are lists of keys by rank."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.keys = np.array(sorted({k for p in profiles.values() for k in p}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), PROFILE, np.int32)  # the last is for n-grams of no profile
        for n, lang in enumerate(self.langs):
            self.ranks[n, np.searchsorted(self.keys, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top(text or "")
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        away = np.abs(self.ranks[:, at] - np.arange(len(own), dtype=np.int32)).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - min(int(away[best]) / (PROFILE * len(own)), 1.0)


def _gram_rows(batches):
    for b in batches:
        rows: list[list] = [[], [], []]
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys, counts = gram_counts(text or "")
            rows[0] += [lang] * len(keys)
            rows[1].append(keys)
            rows[2].append(counts)
        if rows[1]:
            lang = pa.array(rows[0], pa.string())
            both = pa.table([lang, pa.array(np.concatenate(rows[1])), pa.array(np.concatenate(rows[2]))], ["lang", "gram", "n"]).group_by(["lang", "gram"]).aggregate([("n", "sum")])
            yield from both.select(["lang", "gram", "n_sum"]).rename_columns(["lang", "gram", "n"]).to_batches()


def learn(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles from (key, text, lang), lang not null: of each language about sample rows at most, chosen by a hash of the row."""
    sizes = labelled.groupBy("lang").count()
    chosen = labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) * F.col("count") < F.lit(sample << 30))
    counts = chosen.select("lang", "text").mapInArrow(_gram_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect():  # PROFILE rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""

    def run(batches):
        ranker = Ranker(profiles)
        for b in batches:
            found = [ranker.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """What may be learned from: labelled rows that aren't held out."""
    return docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def speaks(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that have a letter; lang_col is filled in with lang_pred where it is null.

    Without profiles rows are judged by their letters alone, and lang_col stays as it is.
    """

    @F.pandas_udf("string")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranker = Ranker(profiles)
        for texts in batches:
            yield texts.map(lambda t: ranker.predict(t)[0])

    if not profiles:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    # called nondeterministic so that it runs once for both uses
    found = docs.withColumn("__lang", predicted.asNondeterministic()(F.col(text_col))).where("__lang <> 'und'")
    return found.withColumn(lang_col, F.coalesce(F.col(lang_col), F.col("__lang"))).select(*docs.columns)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs, learn(labelled_rows(docs)))
