"""Text helpers shared by parsing, digests and corpora."""

from __future__ import annotations

from html import unescape
from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.fixed_values import WHITESPACE

# Entities replaced by ``unescape_known`` when the feed is known to use no others.
COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\xa0", "&#167;": "§",
    "&sect;": "§", "&copy;": "©", "&middot;": "·",
}


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """One pass over all HTML5 named and numeric references; nulls stay null."""
    marked = texts.str.contains("&", regex=False, na=False).astype(bool)
    if not marked.any():
        return texts
    return texts.where(~marked, texts[marked].map(unescape).reindex(texts.index))


def unescape_known(text: Column, entities: dict[str, str] | None = None) -> Column:
    """One-pass unescape for a known entity set, as plain replaces inside codegen.

    The ampersand goes last: it is the only replacement whose result could
    start another reference.
    """
    for entity, char in (COMMON_ENTITIES if entities is None else entities).items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression that is used inside a lambda would be computed again for every
    array element; bound as a lambda variable it is computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_whitespace(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def squash(text: Column) -> Column:
    """Comparison form: no spaces, no commas, lower case."""
    return F.lower(F.translate(text, " ,", ""))


def is_mentioned(thing: Column, name: Column) -> Column:
    """True when the squashed thing occurs in the squashed name."""
    return F.contains(squash(name), squash(thing))


def canonical_label(label: Column) -> Column:
    return F.upper(F.replace(label, F.lit(" "), F.lit("_")))


def bioes_prefix(tag: Column) -> Column:
    """First letter Last/Unit becomes End/Single; everything else is kept."""
    return F.concat(F.translate(F.substring(tag, 1, 1), "LU", "ES"), tail(tag, 2))


def tail(text: Column, start: int) -> Column:
    """``text`` from 1-based position ``start`` to its end."""
    return F.substr(text, F.lit(start))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with 0-based character offsets."""
    return F.substr(text, start + F.lit(1), end - start)


def hash_fraction(key: Column) -> Column:
    """Uniform value in [0, 1) that depends on ``key`` only."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def words(text: Column) -> Column:
    """Non-empty pieces between whitespace characters."""
    return F.filter(F.split(F.translate(text, "\n\t\r", "   "), " "), lambda w: w != "")


def match_form(word: Column) -> Column:
    """Form in which words are compared with dictionaries and weights."""
    return F.lower(F.translate(word, ".,;:!?()", ""))
