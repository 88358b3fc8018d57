"""Text primitives as Column expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_END = r"(?U)(?<=[.!?…])\s+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """White space collapsed to single spaces."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_label(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def sentences(c: Column) -> Column:
    """Sentences as an array: a break is white space after . ! ? or an ellipsis."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_END), strip), lambda x: x != "")


def long_pieces(c: Column, least: int = 20) -> Column:
    """The older split at . ! ? that keeps pieces of more than ``least`` characters."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?]+"), strip), lambda x: F.length(x) > least)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\n\s*\n"), strip), lambda x: x != "")


def windows(units: Column, size: int) -> Column:
    """Sliding windows of ``size`` units, joined by a space; fewer units give one short window."""
    last = F.greatest(F.lit(1), F.size(units) - size + 1) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(units, i + 1, size), " "))


def units(c: Column, level: str = "sentence", size: int = 3) -> Column:
    if level == "paragraph":
        return paragraphs(c)
    return windows(sentences(c), size) if level == "window" else sentences(c)


def tokens(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), 0)


class Lexicon:
    """Lemmas and content words of a language, from dictionary tables.

    ``lemmas`` (token, lemma) goes to the executors as two Arrow arrays, so it must be bounded:
    a full dictionary of an inflected language has a few million forms.  ``content`` (term,
    is_content) stays a table, which is joined to counted terms only.
    """

    #: Most forms of a dictionary; about 100 MB.
    MAX_FORMS = 5_000_000

    def __init__(self, lemmas: DataFrame | None = None, content: DataFrame | None = None):
        self.content = content
        #: (token, lemma), one row a token, or None.
        self.forms = None if lemmas is None else lemmas.groupBy("token").agg(F.min("lemma").alias("lemma"))
        self._arrays: tuple | None = None

    def arrays(self) -> tuple | None:
        """The whole dictionary as two Arrow arrays, fetched once; refused beyond MAX_FORMS rather than cut."""
        if self._arrays is None and self.forms is not None:
            self._arrays = self._fetched(self.forms)
        return self._arrays

    def arrays_for(self, words: list[str]) -> tuple | None:
        """As much of the dictionary as tells which tokens become one of the words: their forms, and the words' own entries."""
        if self.forms is None or self._arrays is not None:
            return self._arrays
        w = self.forms.sparkSession.createDataFrame(pa.table({"w": pa.array(sorted(set(words)), pa.string())}))
        by = lambda c: self.forms.join(F.broadcast(w), F.col(c) == F.col("w"), "left_semi")
        return self._fetched(by("lemma").unionByName(by("token")).distinct())

    def _fetched(self, forms: DataFrame) -> tuple:
        rows = forms.limit(self.MAX_FORMS + 1).toArrow()
        if rows.num_rows > self.MAX_FORMS:
            raise ValueError(f"more than {self.MAX_FORMS} forms")
        return rows.column("token").combine_chunks(), rows.column("lemma").combine_chunks()

    def __call__(self, toks: Column, kind: str = "array<string>") -> Column:
        """An array of tokens (or, by ``kind``, of arrays of them) as lemmas; unknown tokens stay."""
        if self.forms is None:
            return toks
        forms, of = self.arrays()
        return F.arrow_udf(lambda a: _replaced(a, forms, of), kind)(toks)


def _replaced(a: pa.Array, forms: pa.Array, of: pa.Array) -> pa.Array:
    if pa.types.is_list(a.type):
        a = a.fill_null([]) if a.null_count else a
        a = pa.ListArray.from_arrays(a.offsets, a.values)  # a slice keeps its offsets, and its values whole
        return pa.ListArray.from_arrays(a.offsets, _replaced(a.values, forms, of))
    found = of.take(pc.index_in(a, value_set=forms))
    return pc.coalesce(found, a)


def terms(c: Column, profile) -> Column:
    """The tokens of a text, as lemmas where the profile has a lexicon."""
    found = tokens(c, profile.token)
    return profile.lexicon(found) if profile.lexicon else found


def bigrams(toks: Column) -> Column:
    """Neighbouring tokens (after filtering) joined by a space."""
    n = F.size(toks)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(toks, i - 1), F.get(toks, i)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(pairs)


def grams(toks: Column) -> Column:
    """Unigrams, then bigrams, in text order; repeats stay."""
    return F.concat(toks, bigrams(toks))


def ngrams(toks: Column, n: int) -> Column:
    size = F.size(toks)
    out = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(size < n, F.array().cast("array<string>")).otherwise(out)


def parse_tags(c: Column) -> Column:
    """Comma-separated tags, trimmed, empties dropped; the lone value 1 means none."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.when(c.isNull() | (strip(c) == "1"), F.array().cast("array<string>")).otherwise(parts)


def parse_listed_tags(c: Column) -> Column:
    """The looser rule: quotes around tags go too, and nan, true or false mean none."""
    bare = F.lower(strip(c))
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.btrim(strip(x), F.lit("'\" []"))), lambda x: x != "")
    return F.when(c.isNull() | bare.isin("nan", "true", "false", ""), F.array().cast("array<string>")).otherwise(parts)


def excel_date(serial: Column) -> Column:
    """Spreadsheet day numbers, with the leap day of 1900 that never was."""
    n = serial.cast("int")
    return F.when(n.isNull(), None).otherwise(F.expr("DATE'1899-12-31'") + (n - F.when(n > 59, 1).otherwise(0)))


def overlap_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}]{3,}"), 0))


def hits(blob: Column, keywords: list[str]) -> Column:
    """The keywords contained in a text, in the list's order."""
    if not keywords:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(blob, k))
