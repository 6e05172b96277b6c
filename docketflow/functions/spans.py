"""Token sequences held as arrays, one sentence per row.

A sentence never spans rows, so its neighbours are array elements and none of
these functions needs a shuffle. Tokens are ``struct<text,start,end>`` with
character offsets where offsets matter and plain strings elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.functions.text import bioes_prefix, canonical_label, let, tail

SPAN_TYPE = "struct<start:int,end:int,text:string,tag:string>"


def _indices(array: Column) -> Column:
    size = F.size(array)
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


#: Sentences whose results a task holds at a time; an Arrow batch may hold 10,000 of any length.
_SENTENCES = 256


def _pieces(*columns: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """A batch in pieces of a bounded number of rows."""
    for at in range(0, len(columns[0]), _SENTENCES):
        yield tuple(c.iloc[at:at + _SENTENCES] for c in columns)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _running_ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Where each word ends when one character separates it from the next."""
    for batch in batches:
        for (lengths,) in _pieces(batch):
            yield lengths.map(lambda n: np.cumsum(n + 1) - 1 if n is not None else None)


def with_offsets(words: Column) -> Column:
    """Words that were separated by one character each → token structs with offsets.

    A running sum has no array expression that does not copy the array at every
    step, so the sums (only the numbers) are made in Arrow batches.
    """
    def token(word: Column, end: Column) -> Column:
        return F.struct(word.alias("text"), (end - F.length(word)).alias("start"), end.alias("end"))

    ends = _running_ends(F.transform(words, F.length))
    return F.filter(F.zip_with(words, ends, token), lambda t: t["text"] != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _biluo(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Tags from starts and ends of the tokens, and starts, ends and labels of the spans."""
    def tags(first, last, a, b, names):
        if first is None or a is None:
            return None
        made = np.full(len(first), "O", object)
        for x, y in zip(a, b):
            made[np.searchsorted(last, x, side="right"):np.searchsorted(first, y)] = "-"
        for x, y, name in zip(a[::-1], b[::-1], names[::-1]):   # of overlapping spans the first one counts
            i, j = np.searchsorted(first, x), np.searchsorted(last, y)
            if i <= j < len(first) and first[i] == x and last[j] == y:
                made[i:j + 1] = f"I-{name}"
                made[i], made[j] = (f"B-{name}", f"L-{name}") if i < j else (f"U-{name}", f"U-{name}")
        return made

    for batch in batches:
        for piece in _pieces(*batch):
            yield pd.Series([tags(*row) for row in zip(*piece)])


def biluo_tags(tokens: Column, spans: Column) -> Column:
    """Tags of tokens from character spans: B/I/L inside, U alone, O outside.

    Tokens touched by a span that does not begin and end on token edges get ``-``.
    Every span finds its tokens by binary search; the tokens have to be in order.
    """
    return _biluo(tokens["start"], tokens["end"], spans["start"], spans["end"], spans["label"])


def to_bioes(tags: Column) -> Column:
    return F.transform(tags, bioes_prefix)


def repair_raw_tags(tags: Column) -> Column:
    """Label-tool export → BIOES: an ``I-`` not followed by the same raw tag ends its span."""

    def fix(raw: Column, following: Column) -> Column:
        tag = bioes_prefix(raw)
        ends = F.startswith(tag, F.lit("I")) & ~F.equal_null(following, tag)
        return canonical_label(F.when(ends, F.concat(F.lit("E"), tail(tag, 2))).otherwise(tag))

    return let(tags, lambda all_tags: F.transform(all_tags, lambda t, i: fix(t, F.get(all_tags, i + 1))))


def repair_stray_tags(tags: Column, stray: str = ")") -> Column:
    """A stray tag becomes ``O``."""
    return F.transform(tags, lambda t: F.when(t == stray, F.lit("O")).otherwise(t))


def decode_spans(tokens: Column, tags: Column) -> Column:
    """BIOES tags → spans (token positions, end exclusive; text; class).

    A span begins at B or S, after an outside token, or where the class changes,
    so sequences without an opener are still read.
    """
    return let(F.struct(tokens.alias("w"), tags.alias("t")), lambda s: _decode(s["w"], s["t"]))


def _decode(tokens: Column, tags: Column) -> Column:
    def inside(i: Column) -> Column:
        tag = F.get(tags, i)
        return F.coalesce(F.contains(tag, F.lit("-")) & (F.length(tag) > 2), F.lit(False))

    def begins(i: Column) -> Column:
        tag, before = F.get(tags, i), F.get(tags, i - 1)
        return inside(i) & (
            F.substring(tag, 1, 2).isin("B-", "S-") | (i == 0) | ~inside(i - 1)
            | F.coalesce(tail(tag, 3) != tail(before, 3), F.lit(True)))

    positions = _indices(tags)
    first = F.filter(positions, begins)
    last = F.filter(positions, lambda i: inside(i) & (~inside(i + 1) | begins(i + 1)))
    return F.transform(
        F.arrays_zip(first.alias("a"), last.alias("b")),
        lambda p: F.struct(
            p["a"].alias("start"), (p["b"] + 1).alias("end"),
            F.array_join(F.slice(tokens, p["a"] + 1, p["b"] - p["a"] + 1), " ").alias("text"),
            tail(F.get(tags, p["a"]), 3).alias("tag")))


def has_marker_text(words: Column, marker: tuple[str, str]) -> Column:
    return F.contains(F.array_join(words, " "), F.lit(" ".join(marker)))


def _marker_hits(marker: tuple[str, str]):
    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def mark(words):
            if words is None:
                return None
            second = words == marker[1]
            before = np.maximum.accumulate(np.where(second, -1, np.arange(len(words)))) if len(words) else np.zeros(0, int)
            return second & (before >= 0) & (words[before] == marker[0])
        for batch in batches:
            for (rows,) in _pieces(batch):
                yield rows.map(mark)
    return hits


def rewrite_after_marker(words: Column, tags: Column, marker: tuple[str, str], replacement: list[str]) -> Column:
    """Sentence from its first marker on, every marker replaced, as ``(token, tag)`` structs.

    The second marker word counts where it follows the first, repeats of it included.
    Empty when the marker only occurs inside longer words.
    """
    hits = _marker_hits(marker)(F.when(has_marker_text(words, marker), words))
    return let(F.struct(words.alias("w"), tags.alias("t"), hits.alias("h")),
               lambda s: _rewrite(s["w"], s["t"], s["h"], replacement))


def _rewrite(words: Column, tags: Column, hits: Column, replacement: list[str]) -> Column:
    inserted = F.array(*[F.struct(F.lit(w).alias("token"), F.lit("O").alias("tag")) for w in replacement])

    def emit(row: Column) -> Column:
        kept = F.array(F.struct(row["w"].alias("token"), row["t"].alias("tag")))
        return F.when(row["h"], inserted).otherwise(kept)

    first = F.array_position(hits, F.lit(True)).cast("int")
    rows = F.arrays_zip(words.alias("w"), tags.alias("t"), hits.alias("h"))
    rest = F.slice(rows, F.greatest(first, F.lit(1)), F.size(rows))
    return F.when(first > 0, F.flatten(F.transform(rest, emit)))
