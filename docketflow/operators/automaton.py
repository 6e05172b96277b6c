"""Dictionary tagging by an automaton over the phrases: one pass over each text, whatever the number of phrases.

The phrases are put into a trie with failure links, three steps a word, built once in each Python task from a table that is
broadcast after its size is checked. Beyond that size every share of the texts gets the phrases it can use:
:func:`docketflow.operators.large_dictionary.tag_by_shares`. Both give the same matches.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.functions.spans import SPAN_TYPE
from docketflow.operators.large_dictionary import tag_by_shares
from docketflow.operators.tagging import phrase_form
from docketflow.session import cut_lineage

#: Phrases and characters a task may hold as an automaton; some 100 bytes of memory for each word.
MAX_PHRASES = 500_000
MAX_CHARACTERS = 10_000_000

#: Texts whose matches a task holds at a time, and phrases it reads at a time.
_TEXTS = 256
_PHRASES = 10_000

_BREAKS = str.maketrans("\n\t\r", "   ")
_DROP = str.maketrans("", "", ".,;:!?()")


def dictionary(gazetteer: DataFrame) -> DataFrame:
    """The dictionary in match form: gram, tag; of a phrase's tags the smallest."""
    return gazetteer.groupBy(phrase_form(F.col("phrase")).alias("gram")).agg(F.min("tag").alias("tag")) \
        .where((F.col("gram") != "") & F.col("tag").isNotNull())


#: A word outside all phrases.
_OTHER = "   "


def _code(number: int) -> str:
    """A word's number as three signs; each place has signs of its own, so matches begin and end with words.

    No node of the trie has more than 256 branches, which are searched one by one.
    """
    return chr(0x100 + (number >> 16)) + chr(0x200 + (number >> 8 & 255)) + chr(0x300 + (number & 255))


class Automaton:
    """Leftmost, then longest matches of phrases in a text, by words; phrases of fewer than 2^24 words."""

    def __init__(self, phrases: Iterable[tuple[str, str]]):
        import ahocorasick
        self._trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self._codes: dict[str, str] = {}
        self._counts, self._tags, self._names = array("i"), array("i"), {}
        for at, (gram, tag) in enumerate(phrases):
            steps = [self._codes.get(w) or self._codes.setdefault(w, _code(len(self._codes))) for w in gram.split(" ")]
            self._trie.add_word("".join(steps), at)
            self._counts.append(len(steps))
            self._tags.append(self._names.setdefault(tag, len(self._names)))
        self._names = list(self._names)
        if self._counts:
            self._trie.make_automaton()

    def tag(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, text, tag) of every match; places count words."""
        words = [w for w in text.translate(_BREAKS).split(" ") if w]
        if not self._counts or not words:
            return []
        best: dict[int, int] = {}
        for last, phrase in self._trie.iter("".join([self._codes.get(w.translate(_DROP).lower(), _OTHER) for w in words])):
            start = (last + 1) // 3 - self._counts[phrase]
            if start not in best or self._counts[best[start]] < self._counts[phrase]:
                best[start] = phrase
        found, upto = [], 0
        for start in sorted(best):
            if start >= upto:
                upto = start + self._counts[best[start]]
                found.append((start, upto, " ".join(words[start:upto]), self._names[self._tags[best[start]]]))
        return found


def automaton_spans(df: DataFrame, text_column: str, phrases: DataFrame, name: str = "spans") -> DataFrame:
    """Adds the matches as an array; ``phrases`` (gram, tag) is collected, so its size has to be checked before."""
    held = df.sparkSession.sparkContext.broadcast(phrases.select("gram", "tag").toArrow())

    @F.pandas_udf(f"array<{SPAN_TYPE}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(row for part in held.value.to_batches(_PHRASES) for row in zip(*[c.to_pylist() for c in part.columns]))
        for texts in batches:
            for at in range(0, len(texts), _TEXTS):   # an Arrow batch may hold far more matches than a task's memory should
                yield pd.Series([[dict(zip(("start", "end", "text", "tag"), s)) for s in automaton.tag(t or "")]
                                 for t in texts.iloc[at:at + _TEXTS]])

    return df.withColumn(name, run(F.col(text_column)))


def tag_documents(df: DataFrame, key: str, text_column: str, gazetteer: DataFrame, max_phrases: int = MAX_PHRASES,
                  max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """Rows key, start, end, text, tag of a dictionary table's matches: by automaton, or by shares if it is too large."""
    phrases = cut_lineage(dictionary(gazetteer))
    n, size = phrases.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("gram")), F.lit(0))).first()
    if n > max_phrases or size > max_characters:
        return tag_by_shares(df, key, text_column, phrases)
    found = automaton_spans(df.select(key, text_column), text_column, phrases)
    return found.select(key, F.explode("spans").alias("s")).select(key, "s.*")
