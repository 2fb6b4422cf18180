"""Scalar text functions, all of them Column expressions but NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.lexicon import has


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def tidy(text: Column) -> Column:
    """Drops control characters but tab and line ends, makes all line ends \\n, trims blanks before them."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "[ \\t]+\\n", "\n")


def clean_text(text: Column, nfkc: bool = True) -> Column:
    """tidy() after NFKC, which only texts beyond ASCII go through Python for."""
    return tidy(F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc(text)).otherwise(text) if nfkc else text)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1)


def stopword_share(text: Column) -> tuple[Column, Column]:
    """Number of words, and the share of stopwords among them."""
    words = ascii_words(F.lower(text))
    n = F.size(words)
    return n, F.size(F.filter(words, lambda w: has(w, "stopword"))) / F.greatest(n, F.lit(1))


def english_ratio(text: Column) -> Column:
    """What the gate reports: the share of stopwords to four places, 1 for texts of under 30 words, which it doesn't judge."""
    n, share = stopword_share(text)
    return F.when(n < 30, F.lit(1.0)).otherwise(F.bround(share, 4))


def is_english(text: Column) -> Column:
    """Texts of under 30 words pass; others need 15 % of stopwords."""
    n, share = stopword_share(text)
    return (n < 30) | (share >= 0.15)


def is_short_non_prose(text: Column) -> Column:
    n, share = stopword_share(text)
    return (n < 30) & ((n == 0) | (share < 0.15))


def normalize_name(name: Column) -> Column:
    return F.btrim(F.btrim(F.regexp_replace(name, "\\s+", " ")), F.lit(".,;:()[]{}\"'-"))


def strip_possessive(name: Column) -> Column:
    return F.regexp_replace(name, "['\\u2019]s$", "")


def preceding_word(prefix: Column) -> Column:
    return F.regexp_extract(prefix, "([A-Za-z']+)\\s*$", 1)


def following_char(suffix: Column) -> Column:
    return F.substring(F.ltrim(suffix, F.lit(" \t")), 1, 1)


def excerpt(line: Column, start: Column, end: Column, width: int = 120) -> Column:
    """The mention within its line, marked, with up to width characters on either side."""
    low = F.greatest(start - width, F.lit(0))
    return F.concat(F.substring(line, low + 1, start - low), F.lit("[["), F.substring(line, start + 1, end - start), F.lit("]]"), F.substring(line, end + 1, F.lit(width)))


def delimiter(first_line: Column) -> Column:
    """The most frequent of , ; tab |; the first of these in a tie; a comma if there is none."""
    counts = F.array(*[F.struct(F.regexp_count(first_line, F.lit(p)).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, (d, p) in enumerate(((",", ","), (";", ";"), ("\t", "\\t"), ("|", "\\|")))])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def html_to_text(html: Column) -> Column:
    """Text of well-formed pages: skipped elements go, block tags end lines, cells are joined by |, entities are decoded."""
    t = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, "(?is)<(script|style|noscript|template|svg|object|iframe)\\b.*?</(script|style|noscript|template|svg|object|iframe)>", "")
    t = F.regexp_replace(t, "(?i)</?(td|th)\\b[^>]*>", " | ")
    t = F.regexp_replace(t, "(?i)</?(p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|table|tr|title|body|head|html)\\b[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), " ?\\n ?", "\n")
    return F.btrim(F.regexp_replace(t, "\\n{3,}", "\n\n"), F.lit(" \n"))


# Letters that have no decomposition, and what stands for them.
LETTERS = {"ß": "ss", "Æ": "Ae", "æ": "ae", "Œ": "Oe", "œ": "oe", "Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "ı": "i", "Ħ": "H", "ħ": "h"}


def _accents() -> dict[str, str]:
    """Latin letters with marks, and the letters without."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and c not in LETTERS:
            found[c] = plain
    return found


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks."""
    table = _accents()
    for c, plain in [*LETTERS.items(), *((c, x) for c, x in table.items() if len(x) > 1)]:
        text = F.replace(text, F.lit(c), F.lit(plain))
    single = {c: x for c, x in table.items() if len(x) == 1}
    return F.regexp_replace(F.translate(text, "".join(single), "".join(single.values())), "[\\u0300-\\u036F]", "")


def folded(key: str) -> str:
    """fold_accents() of a string in lower case."""
    table = {**_accents(), **LETTERS}
    plain = "".join(table.get(c, c) for c in unicodedata.normalize("NFC", key))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def fold_key(key: Column) -> Column:
    """fold_accents() of keys in lower case: fewer letters to replace, cheap enough for every word."""
    table = {c: x.lower() for c, x in {**_accents(), **LETTERS}.items() if c == c.lower()}
    for c, plain in ((c, x) for c, x in table.items() if len(x) > 1):
        key = F.replace(key, F.lit(c), F.lit(plain))
    single = {c: x for c, x in table.items() if len(x) == 1}
    return F.regexp_replace(F.translate(key, "".join(single), "".join(single.values())), "[\\u0300-\\u036F]", "")


def sentences(line: Column) -> Column:
    """A line cut after . ! or ? and blanks before a capital or a quotation mark with one."""
    return F.split(line, "(?<=[.!?])\\s+(?=[\"']?[A-Z])", -1)


def chunk_sizes(text: Column, cap: int = 400_000) -> Column:
    """Lengths of the chunks of at most cap characters that whole lines fill from the first on; longer lines are cut."""
    lengths = F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1)
    pieces = F.flatten(F.transform(lengths, lambda n: F.concat(F.array_repeat(F.lit(cap), F.floor(n / cap).cast("int")), F.filter(F.array((n % cap).cast("int")), lambda r: r > 0))))
    fold = "struct<done:array<int>,open:int>"

    def add(state, n):
        fits = state["open"] + n <= cap
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"), F.when(fits, state["open"] + n).otherwise(n).alias("open")).cast(fold)

    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("open")).cast(fold)
    return F.aggregate(pieces, start, add, lambda s: F.concat(s["done"], F.array(s["open"])))


def entity_parts(entity: Column) -> Column:
    """The parts of an entity between line ends and words with digits."""
    return F.filter(F.transform(F.split(entity, "\n|\\S*[0-9]\\S*"), lambda x: F.btrim(x)), lambda x: x != "")
