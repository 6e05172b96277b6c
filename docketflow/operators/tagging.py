"""Taggers: text → ``array<struct<start,end,text,tag>>`` (word positions, end exclusive)."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.fixed_values import NO_CATEGORY
from docketflow.functions.spans import SPAN_TYPE, _indices
from docketflow.functions.text import let, match_form, words

def phrase_form(phrase: Column) -> Column:
    return F.array_join(F.transform(words(phrase), match_form), " ")


def _fold(hits: Column) -> Column:
    """Walks hits by start position and drops those that begin inside a kept one."""
    start = F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<{SPAN_TYPE}>").alias("kept"))

    def step(acc: Column, hit: Column) -> Column:
        free = hit["start"] >= acc["upto"]
        return F.struct(F.when(free, hit["end"]).otherwise(acc["upto"]).alias("upto"),
                        F.when(free, F.array_append(acc["kept"], hit)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(hits, start, step, lambda acc: acc["kept"])


def _leftmost_longest(hits: Column) -> Column:
    """Leftmost, then longest hits without overlaps; hits come by start, one for each start.

    The walk copies what it has kept at every hit, so it is made in short stretches:
    a hit that none of those before it reaches begins a new one. Only hits up to the
    longest hit's words before can reach it.
    """
    def stretches(all_hits: Column, begins: Column) -> Column:
        return F.flatten(F.transform(begins, lambda i, k: _fold(
            F.slice(all_hits, i + 1, F.coalesce(F.get(begins, k + 1), F.size(all_hits)) - i))))

    def begun(x: Column) -> Column:
        def free(i: Column) -> Column:
            before = F.slice(x["h"], F.greatest(i - x["n"] + 2, F.lit(1)), F.least(i, x["n"] - 1))
            return ~F.exists(before, lambda p: p["end"] > F.get(x["h"], i)["start"])
        return let(F.filter(_indices(x["h"]), free), lambda begins: stretches(x["h"], begins))

    longest = F.coalesce(F.array_max(F.transform(hits, lambda h: h["end"] - h["start"])), F.lit(1))
    return let(F.struct(hits.alias("h"), longest.alias("n")), begun)


def dictionary_spans(text: Column, gazetteer: dict[str, str]) -> Column:
    """Phrases of a dictionary given in the plan: leftmost, then longest, no overlaps.

    No join, no shuffle. The dictionary becomes part of the plan, so this is for
    lists written by hand; :func:`dictionary_matches` takes a table.
    """
    by_length: dict[int, dict[str, str]] = {}
    for phrase, tag in gazetteer.items():
        by_length.setdefault(len(phrase.split()), {})[phrase.lower()] = tag
    beginnings = sorted({phrase.split()[0].lower() for phrase in gazetteer})
    nothing = F.lit(None).cast(SPAN_TYPE)

    def hit_at(plain: Column, forms: Column, i: Column) -> Column:
        best = nothing
        for length, phrases in sorted(by_length.items()):   # longest ends up outermost
            gram = F.get(forms, i) if length == 1 else F.array_join(F.slice(forms, i + 1, length), " ")
            table = F.create_map(*[F.lit(part) for pair in phrases.items() for part in pair])
            span = F.struct(
                i.alias("start"), (i + length).alias("end"),
                F.array_join(F.slice(plain, i + 1, length), " ").alias("text"),
                F.element_at(table, gram).alias("tag"))
            best = F.when(gram.isin(list(phrases)), span).otherwise(best)
        return best

    def hits(plain: Column, forms: Column) -> Column:
        begun = F.filter(_indices(forms), lambda i: F.get(forms, i).isin(beginnings))
        return F.array_compact(F.transform(begun, lambda i: hit_at(plain, forms, i)))

    found = let(words(text), lambda plain: let(F.transform(plain, match_form), lambda forms: hits(plain, forms)))
    return found if max(by_length, default=1) == 1 else let(found, _leftmost_longest)


def dictionary_matches(df: DataFrame, key: str, text_column: str, gazetteer: DataFrame) -> DataFrame:
    """The same matching against a dictionary table (``phrase, tag``) of any size and any phrase length.

    Single words look up which phrases begin with them; only there, and only in the
    lengths these phrases have, word groups are built and joined with the table. So
    what is shuffled is (key, place, word) and candidates, never texts; candidates of
    a text meet again at the text, so a group is bounded by one text.
    Rows: key, start, end, text, tag. Keys must not repeat.
    """
    table = gazetteer.groupBy(phrase_form(F.col("phrase")).alias("gram")).agg(F.min("tag").alias("tag")) \
        .where(F.col("gram") != "")
    begins = table.select(F.substring_index("gram", " ", 1).alias("word"), F.size(F.split("gram", " ")).alias("n")).distinct()
    split = df.select(F.col(key), words(F.col(text_column)).alias("w"))
    places = split.select(key, F.posexplode(F.transform("w", match_form)).alias("i", "word"))
    near = places.join(begins, "word").groupBy(key).agg(F.collect_list(F.struct("i", "n")).alias("near"))
    def gram(c: Column) -> Column:
        return F.struct(c["i"].alias("start"), (c["i"] + c["n"]).alias("end"), F.slice("w", c["i"] + 1, c["n"]).alias("part"))

    # Cut inside the row: a row for each candidate would carry the whole text until it is cut.
    inside = F.filter("near", lambda c: c["i"] + c["n"] <= F.size("w"))
    grams = split.join(near, key).select(key, F.explode(F.transform(inside, gram)).alias("g")).select(key, "g.*")
    found = grams.select(key, "start", "end", F.array_join("part", " ").alias("text"),
                         F.array_join(F.transform("part", match_form), " ").alias("gram")) \
        .join(table, "gram").select(key, F.struct("start", "end", "text", "tag").alias("hit"))
    longest = found.groupBy(key, "hit.start").agg(F.max_by("hit", "hit.end").alias("hit"))
    hits = F.array_sort(F.collect_list("hit")).cast(f"array<{SPAN_TYPE}>")
    return longest.groupBy(key).agg(hits.alias("hits")) \
        .select(key, F.explode(_leftmost_longest(F.col("hits"))).alias("s")).select(key, "s.*")


# A tagger factory runs once per Python task and returns a function from a list of
# texts to a list of (start, end, text, tag) for each.
TaggerFactory = Callable[[], Callable[[list], list]]


def tag_with(df: DataFrame, text_column: str, factory: TaggerFactory, name: str = "spans", batch_size: int = 256) -> DataFrame:
    """Tag a text column with any tagger, in Arrow batches; only the text travels.

    The tagger sees ``batch_size`` texts at a time; nulls come to it as empty texts.
    """
    fields = ("start", "end", "text", "tag")

    @F.pandas_udf(f"array<{SPAN_TYPE}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = factory()
        for texts in batches:
            values = texts.fillna("").tolist()
            found = [spans for at in range(0, len(values), batch_size) for spans in tagger(values[at:at + batch_size])]
            yield pd.Series([[dict(zip(fields, s)) for s in spans] for spans in found])

    return df.withColumn(name, run(F.col(text_column)))


def word_tagger(tags: dict[str, str]) -> TaggerFactory:
    """Tags single words by their match form; only the distinct words of a batch are looked up."""
    breaks, drop = str.maketrans("\n\t\r", "   "), str.maketrans("", "", ".,;:!?()")

    def build() -> Callable[[list], list]:
        def tag(texts: list) -> list:
            cut = [[w for w in t.translate(breaks).split(" ") if w] for t in texts]
            ends = np.cumsum([len(row) for row in cut])
            numbers, distinct = pd.factorize(np.array([w for row in cut for w in row], object))
            known = [tags.get(w.translate(drop).lower()) for w in distinct]
            hits = np.flatnonzero(np.array([k is not None for k in known], bool)[numbers]) if len(numbers) else []
            found: list[list] = [[] for _ in texts]
            for hit, row in zip(hits, np.searchsorted(ends, hits, side="right")):
                at = int(hit - (ends[row - 1] if row else 0))
                found[row].append((at, at + 1, distinct[numbers[hit]], known[numbers[hit]]))
            return found
        return tag

    return build


def gazetteer_from_spans(spans: DataFrame) -> DataFrame:
    """Dictionary learnt from tagged corpora: the most frequent class of every span text."""
    counts = spans.groupBy(phrase_form(F.col("text")).alias("phrase"), "tag").count()
    return counts.groupBy("phrase").agg(F.max_by("tag", F.struct("count", "tag")).alias("tag"))


def entity_rows(tagged: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per kept span: ``thing_searched, category, span_pos``.

    Spans of ``L-`` classes are dropped. A text without spans gives one row with
    no thing; a text whose spans were all dropped gives none.
    """
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(NO_CATEGORY).alias("tag")))
    pairs = F.transform(F.filter(spans, lambda s: ~F.startswith(s["tag"], F.lit("L-"))),
                        lambda s: F.struct(s["text"].alias("text"), s["tag"].alias("tag")))
    rows = F.when(F.size(spans) == 0, nothing).otherwise(pairs)
    kept = [c for c in tagged.columns if c != spans]
    return tagged.select(*kept, F.posexplode(rows).alias("span_pos", "_e")) \
        .select(*kept, F.col("_e.text").alias("thing_searched"), F.col("_e.tag").alias("category"), "span_pos")
