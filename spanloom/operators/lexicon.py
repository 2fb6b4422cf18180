"""Word lists, held as one small table (list_name, key); all our own, and replaceable by a user's."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = {
    "first": ["anna", "maria", "john", "peter", "laura", "david", "karl", "stteen", "april", "jordan"],
    "last": ["keller", "lopez", "smith", "novak", "stone", "erachtz", "young", "jordan"],
    "location": ["paris", "berlin", "new york", "africa", "jordan"],
    "organization": ["license", "bank", "group", "office", "apache"],
    "stopword": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as", "this", "are", "at", "from", "or", "he"],
    "common": ["young", "stone", "happy", "birthday", "dear", "orre", "an", "the"],
    "calendar": ["monday", "friday", "april", "august"],
    "title": ["dr", "mr", "mrs", "prof"],
    "honorific": ["sir", "lady", "rev"],
    "language": ["english", "french", "german"],
    "ambiguous": ["orre", "april"],
    "blacklist": ["happy birthday", "dear john"],
    "occupation": ["doctor", "engineer"],
    "marker": ["und", "avec", "nicht"],
    "campaign": ["clean city", "open day"],
    "slogan": ["save", "vote", "welcome"],
}


#: What using() set: lists that stand in place of those above.
_USED: ContextVar[dict[str, list[str]]] = ContextVar("lists", default={})
#: Keys that one list may have: lists are constants in the plan.
MOST_KEYS = 20_000


def keys(name: str) -> list[str]:
    """The list in force."""
    return _USED.get().get(name, LISTS[name])


@contextmanager
def using(lists: dict[str, list[str]]) -> Iterator[None]:
    """Plans built within it hold these lists (in lower case) in place of the own ones of the same names.

    An unknown name, or over MOST_KEYS keys in a list, is a ValueError. An empty list has no keys.
    """
    unknown = set(lists) - set(LISTS)
    large = [n for n, ks in lists.items() if len(ks) > MOST_KEYS]
    if unknown or large:
        raise ValueError(f"no such list: {sorted(unknown)}, over {MOST_KEYS} keys: {large}")
    token = _USED.set({**_USED.get(), **{n: sorted({k.lower() for k in ks}) for n, ks in lists.items()}})
    try:
        yield
    finally:
        _USED.reset(token)


def read_lists(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Lists for using() from tables (key), such as readers.word_list() gives; no more than MOST_KEYS + 1 keys of each reach the driver."""
    return {n: [r.key for r in t.select("key").distinct().limit(MOST_KEYS + 1).collect()] for n, t in tables.items()}


def lexicon(spark: SparkSession) -> DataFrame:
    """(list_name, key), a literal table of fixed size."""
    rows = [F.struct(F.lit(n).alias("list_name"), F.lit(k).alias("key")) for n in LISTS for k in keys(n)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def has(key: Column, name: str) -> Column:
    """Whether a key is in a list; folded into the plan, so that no join is needed for lists of this size."""
    return key.isin(keys(name))


def name_key(key: Column) -> Column:
    """A key under which a name is looked up: without its marks where it has letters beyond ASCII and only so is a known name.

    The reverse isn't done: a plain key doesn't find a listed name with marks.
    """
    from ..functions.text import fold_key, folded

    plain = {n: sorted({folded(k) for k in keys(n)}) for n in ("first", "last")}
    found = F.coalesce(fold_key(key).isin(plain["first"]) | fold_key(key).isin(plain["last"]), F.lit(False))
    return F.when(key.rlike(r"[^\x00-\x7F]") & ~has(key, "first") & ~has(key, "last") & found, fold_key(key)).otherwise(key)


def collisions(lex: DataFrame) -> DataFrame:
    """Keys in more than one list."""
    return lex.groupBy("key").agg(F.count("*").alias("n_lists"), F.concat_ws(",", F.sort_array(F.collect_set("list_name"))).alias("lists")).where("n_lists > 1")
