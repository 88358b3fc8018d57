"""Texts as arrays of token codes, for kernels that go over Arrow batches with numpy.

Patterns of the shape of ``Profile.token`` (a class of letters, with or without hyphens inside, and a
least length) are sought in the bytes of whole batches; for any other pattern the JVM makes the
tokens.  Both give the same tokens.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Bytes of text that are gone over at once (a longer text stands alone).
CHUNK_BYTES = 4 << 20
#: No letters beyond this code point.
_LAST = 0x33480
_SHAPE = re.compile(r"(?P<c>\\p\{L\}|\[[^\\\]^]+\])(?:\[(?P<inner>.+)\\-\])?\{(?P<n>\d+),\}")
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Kind(NamedTuple):
    letters: np.ndarray  # by code point
    hyphen: bool
    least: int


@lru_cache
def kind_of(pattern: str) -> Kind | None:
    """What a token pattern says, or None if it is of another shape."""
    m = _SHAPE.fullmatch(pattern)
    if m is None or (m["inner"] is not None and m["inner"] not in (m["c"], m["c"][1:-1])):
        return None
    table = np.zeros(0x110000, bool)
    if m["c"] == r"\p{L}":
        table[:_LAST] = [unicodedata.category(chr(i))[0] == "L" for i in range(_LAST)]
    else:
        one = re.compile(m["c"])
        table[:_LAST] = [one.match(chr(i)) is not None for i in range(_LAST)]
    return Kind(table, m["inner"] is not None, int(m["n"]) + (m["inner"] is not None))


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, code point, bytes) of the characters of more than one byte."""
    at = np.flatnonzero(data >= 0xC0)
    b = data[at].astype(np.int64)
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    point = b & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        has = size > k
        point[has] = point[has] << 6 | (data[at[has] + k] & 0x3F)
    return at, point, size


class Coded(NamedTuple):
    """The tokens of the texts first to last of a batch; ``doc`` counts from first."""

    first: int
    last: int
    code: np.ndarray
    names: pa.StringArray
    doc: np.ndarray
    unit: np.ndarray | None  # sentence, counted over all texts
    data: np.ndarray | None
    cuts: np.ndarray | None  # where each sentence begins


def _spans(data: np.ndarray, edges: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin and end; ``edges`` are the places where texts begin, and the end."""
    low = np.zeros(256, bool)
    low[:128] = kind.letters[:128]
    letter = low[data]
    wide = bool(len(data)) and bool((data >= 0x80).any())
    if wide:
        at, point, size = _points(data)
        ok = kind.letters[point]
        at, size = at[ok], size[ok]
        letter[at] = True
        for k in (1, 2, 3):
            letter[at[size > k] + k] = True
    part = letter | (data == 45) if kind.hyphen else letter
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    before, after = np.concatenate([[False], part[:-1]]), np.concatenate([part[1:], [False]])
    start, end = np.flatnonzero(part & (cut[:-1] | ~before)), np.flatnonzero(part & (cut[1:] | ~after)) + 1
    if kind.hyphen and len(start):
        lead = np.flatnonzero(data[start] == 45)  # a token begins with a letter
        if len(lead):
            places = np.append(np.flatnonzero(letter), len(data))
            start[lead] = np.minimum(places[np.searchsorted(places, start[lead])], end[lead])
    size = end - start
    if wide:
        inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
        size = size - (inner[end] - inner[start])
    keep = size >= kind.least
    return start[keep], end[keep]


def _sentence_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where a sentence begins, as functions.text.sentences breaks them; stripped bounds may lie further in."""
    space, stop = np.zeros(256, bool), np.zeros(256, bool)
    space[[c for c in _SPACES if c < 128]] = True
    stop[[33, 46, 63]] = True
    sp, st = space[data], stop[data]
    if len(data) and (data >= 0x80).any():
        at, point, size = _points(data)
        sp[at[np.isin(point, _SPACES)]] = True
        e = at[point == 0x2026]
        st[e + 2] = True  # its last byte
    brk = np.zeros(len(data) + 1, bool)
    brk[1:-1] = st[:-1] & sp[1:]
    brk[edges] = True
    return np.flatnonzero(brk[: len(data)]) if len(data) else np.zeros(0, np.int64)


def frame(docs: DataFrame, profile, *columns: str) -> DataFrame:
    """The columns and ``_x``, what chunks() reads: texts in lower case, or tokens where the pattern is of another shape."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return docs.select(*columns, (low if kind_of(profile.token) else tx.tokens(F.col("text"), profile.token)).alias("_x"))


def lemmas_of(profile) -> tuple | None:
    """The dictionary of a profile's lexicon, as two arrays that travel with a kernel."""
    return profile.lexicon.arrays() if profile.lexicon else None


def chunks(column: pa.Array, pattern: str, lemmas: tuple | None = None, units: bool = False, most: int | None = None) -> Iterator[Coded]:
    """The column ``_x`` of a batch in parts of whole texts, of CHUNK_BYTES or ``most`` bytes."""
    kind = kind_of(pattern)
    listed = pa.types.is_list(column.type)
    if listed:
        offsets, per = column.offsets.to_numpy(), 16
    else:
        offsets, per = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1], 1
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, int(offsets[first]) + (most or CHUNK_BYTES) // per, "right")) - 1)
        last = min(last, len(column))
        begin, end = int(offsets[first]), int(offsets[last])
        edges = offsets[first : last + 1].astype(np.int64) - begin
        data = unit = cuts = None
        if listed:
            toks = column.values.slice(begin, end - begin)
            doc = np.repeat(np.arange(last - first), np.diff(edges))
        else:
            data = np.frombuffer(column.buffers()[2], np.uint8)[begin:end] if end > begin else np.zeros(0, np.uint8)
            s, e = _spans(data, edges, kind)
            doc = np.searchsorted(edges, s, "right") - 1
            size = e - s
            inside = np.zeros(len(data) + 1, np.int8)
            inside[s] += 1
            inside[e] -= 1
            picked = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            toks = pa.StringArray.from_buffers(len(s), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(picked)))
            if units:
                cuts = _sentence_starts(data, edges)
                unit = np.searchsorted(cuts, s, "right") - 1
        coded = toks.dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if lemmas is not None:
            other = tx._replaced(names, *lemmas).dictionary_encode()
            code, names = other.indices.to_numpy().astype(np.int64)[code], other.dictionary
        yield Coded(first, last, code, names, doc, unit, data, cuts)
        first = last


def without(c: Coded, words: list[str]) -> Coded:
    """Without some terms; what is left moves together."""
    import pyarrow.compute as pc

    gone = pc.index_in(c.names, value_set=pa.array(words, pa.string())).is_valid().to_numpy(zero_copy_only=False) if words else np.zeros(len(c.names), bool)
    keep = ~gone[c.code]
    return c._replace(code=c.code[keep], doc=c.doc[keep], unit=None if c.unit is None else c.unit[keep])
