"""Alert digests: categories → courts → cases, rendered into message blocks.

A digest is a long table, one row per case line. Strings and JSON bodies are put
together in numbered parts of bounded size, so a court or category that holds
most of the cases never becomes one huge value. Every part carries its heading;
from the second on, with its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.fixed_values import MESSAGE_BLOCKS, NO_CATEGORY
from docketflow.functions.text import html_unescape, is_mentioned
from docketflow.operators.ordering import first_per_key, number_rows
from docketflow.session import cut_lineage

LINES_PER_PART = 500
#: Lines of one category and court that one task may number; beyond it they are numbered in ranges.
LINES_IN_A_TASK = 500_000
_ORDER = ["doc_order", "span_pos"]
#: What a case is known by, whatever its place; places may repeat.
_KEY = ["category", "case_string"]


def _named(name: Column, url: Column) -> Column:
    """The case name, or the address of a case without one."""
    return F.coalesce(name, url, F.lit(""))


def _is_extra(thing: Column, name: Column) -> Column:
    """There is a thing, and the name does not hold it."""
    return F.coalesce((thing != "") & ~F.coalesce(is_mentioned(thing, name), F.lit(False)), F.lit(False))


def case_string(name: Column, court: Column, thing: Column, url: Column) -> Column:
    """Text that identifies a case inside a category; the thing only when the name lacks it.

    A case without a name is known by its address, one without a court has none shown.
    """
    extra = F.when(_is_extra(thing, name), F.concat(F.lit("\n  "), thing)).otherwise(F.lit(""))
    return F.concat(F.lit("- "), _named(name, url), F.lit("    *"), F.coalesce(court, F.lit("")), F.lit("*"), extra)


def digest_cases(entities: DataFrame) -> DataFrame:
    """The first case object of every category and case string, without the no-category group."""
    named = entities.where(F.col("category") != NO_CATEGORY).withColumn("case_string", case_string(
        F.col("case_name"), F.col("court_id"), F.col("thing_searched"), F.col("absolute_url")))
    return first_per_key(named, _KEY, [F.asc(c) for c in (*_ORDER, "absolute_url")])


def _shown_thing(name: Column, thing: Column) -> Column:
    return F.when(_is_extra(thing, name), thing).otherwise(F.lit(""))


def _shown_type(document_type: Column) -> Column:
    shown = F.when(document_type != "", F.concat(F.lit("["), document_type, F.lit("]")))
    return F.coalesce(shown, F.lit(""))


def line_link_style(name: Column, url: Column, thing: Column, document_type: Column, unescape=html_unescape) -> Column:
    shown = unescape(name)
    return F.concat(F.lit("<"), F.coalesce(url, F.lit("None")), F.lit("|"), _named(shown, url), F.lit("> "),
                    _shown_thing(shown, thing), F.lit(" "), _shown_type(document_type), F.lit("\n"))


def line_text_style(name: Column, url: Column, thing: Column, document_type: Column, unescape=html_unescape) -> Column:
    shown_name = unescape(name)
    shown = _shown_thing(shown_name, thing)
    shown = F.when(shown != "", F.concat(F.lit("\n  "), shown)).otherwise(shown)
    return F.concat(F.lit("- "), _named(shown_name, url), F.lit("   "), shown, F.lit(" "), _shown_type(document_type))


def _type_column(cases: DataFrame) -> Column:
    """Feed digests carry a document type, search digests do not."""
    return F.col("document_type") if "document_type" in cases.columns else F.lit(None).cast("string")


def with_lines(cases: DataFrame, unescape=html_unescape) -> DataFrame:
    name, thing, kind = F.col("case_name"), F.col("thing_searched"), _type_column(cases)
    url = F.col("absolute_url")
    return cases.withColumns({
        "link_line": line_link_style(name, url, thing, kind, unescape),
        "text_line": line_text_style(name, url, thing, kind, unescape),
    })


def category_order(cases: DataFrame) -> DataFrame:
    """Categories with their case count and the place of their first case."""
    first = F.min(F.struct(*_ORDER)).alias("first")
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("n_cases"), first) \
        .select("category", "n_cases", F.col("first.doc_order").alias("first_doc_order"),
                F.col("first.span_pos").alias("first_span_pos"))


def ordered_categories(cases: DataFrame) -> DataFrame:
    """Categories with their place in the digest; one row per category, so one small window."""
    place = F.row_number().over(Window.orderBy("first_doc_order", "first_span_pos"))
    return category_order(cases).withColumn("place", place.cast("bigint"))


def numbered_lines(cases: DataFrame, lines_in_a_task: int = LINES_IN_A_TASK) -> DataFrame:
    """Cases with the place of their category, their court as text and ``line_no``, their number inside category and court.

    Lines follow the document order, then the case string, so equal places give no line twice. The cases are kept in the
    shared folder and counted once. Where a category and court hold more than ``lines_in_a_task``, only keys are numbered,
    in ranges, and joined back by the case's key; a court is one stretch of the order, so its number is a difference.
    """
    held = cut_lineage(cases)
    places = ordered_categories(held).select("category", "place")
    rows = held.withColumn("court", F.coalesce("court_id", F.lit(""))).join(places, "category")
    inside, order = ["category", "court"], [*_ORDER, "case_string"]
    sizes = held.groupBy("category", F.coalesce("court_id", F.lit(""))).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= lines_in_a_task:
        line = F.row_number().over(Window.partitionBy(*inside).orderBy(*order))
        return rows.withColumn("line_no", line.cast("bigint"))
    numbered = number_rows(rows.select(*inside, "place", *order), [], ["place", "court", *order], "line")
    first = numbered.groupBy(*inside).agg((F.min("line") - 1).alias("before"))
    lines = numbered.join(first, inside).select(*_KEY, (F.col("line") - F.col("before")).alias("line_no"))
    return rows.join(lines, _KEY)


def court_order(cases: DataFrame) -> DataFrame:
    """Cases numbered inside (category, court), in document order."""
    return numbered_lines(cases).drop("place", "court")


def _sections(numbered_cases: DataFrame, line: str, lines_per_part: int, unescape) -> DataFrame:
    rows = with_lines(numbered_cases, unescape).withColumn("part_no", F.floor((F.col("line_no") - 1) / lines_per_part))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.col(line).alias("line"))))
    text = F.array_join(F.transform(ordered, lambda r: F.concat(F.lit("• "), r["line"])), "\n")
    return rows.groupBy("category", F.coalesce("court_id", F.lit("")).alias("court_id"), "part_no") \
        .agg(F.count(F.lit(1)).alias("n_lines"), text.alias("body"))


def court_sections(cases: DataFrame, line: str = "link_line", lines_per_part: int = LINES_PER_PART,
                   unescape=html_unescape) -> DataFrame:
    """Bulleted text of every (category, court), in parts of bounded size."""
    return _sections(numbered_lines(cases), line, lines_per_part, unescape)


def message_blocks(cases: DataFrame, intro: str | None = None, lines_per_part: int = LINES_PER_PART,
                   max_blocks: int = MESSAGE_BLOCKS, unescape=html_unescape) -> DataFrame:
    """Message blocks in order: intro; per category a divider, a title and one section per court part.

    ``block_no`` runs over the whole digest and ``message_no`` groups blocks into
    messages. Block numbers follow from the number of parts of each category and
    court, a small table; no text takes part in the numbering.
    """
    numbered = numbered_lines(cases)
    whole = Window.orderBy("place", "court").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.ceil(F.col("n") / lines_per_part).cast("bigint")
    opens = F.row_number().over(Window.partitionBy("place").orderBy("court")) == 1
    courts = numbered.groupBy("place", "category", "court").agg(F.max("line_no").alias("n")) \
        .withColumn("n_blocks", parts + F.when(opens, 2).otherwise(0)).withColumn("opens", opens) \
        .withColumn("base", F.coalesce(F.sum("n_blocks").over(whole), F.lit(0)) + (1 if intro else 0))
    body = F.concat(F.lit("*"), F.col("court_id"), F.when(F.col("part_no") > 0, F.concat(
        F.lit(" ("), (F.col("part_no") + 1).cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit(":*\n\n"), F.col("body"))
    first = courts.select("category", F.col("court").alias("court_id"), (F.col("base") + F.when(F.col("opens"), 3).otherwise(1))
                          .alias("first_block"))
    sections = _sections(numbered, "link_line", lines_per_part, unescape) \
        .join(first, ["category", "court_id"]).select(
            (F.col("first_block") + F.col("part_no")).alias("block_no"), F.lit("section").alias("kind"), "category",
            "court_id", "part_no", body.alias("text"))

    def heading(block_no: Column, kind: str, category: Column, text: Column) -> Column:
        return F.struct(block_no.alias("block_no"), F.lit(kind).alias("kind"), category.alias("category"),
                        F.lit("").alias("court_id"), F.lit(0).cast("bigint").alias("part_no"), text.alias("text"))

    base, category, nothing = F.col("base"), F.col("category"), F.lit(None).cast("string")
    titles = [heading(base + 1, "divider", category, nothing),
              heading(base + 2, "section", category, F.concat(F.lit("*"), category, F.lit(":*")))]
    headings = courts.where("opens").select(F.explode(F.array(*titles)).alias("h")).select("h.*")
    rows = sections.unionByName(headings)
    if intro:   # it leads the first category, so an empty digest has no blocks at all
        lead = heading(F.lit(1).cast("bigint"), "section", F.lit(""), F.lit(f"*{intro}:*"))
        rows = rows.unionByName(courts.where((F.col("place") == 1) & F.col("opens")).select(lead.alias("h")).select("h.*"))
    return rows.select("block_no", F.floor((F.col("block_no") - 1) / max_blocks).alias("message_no"),
                       "kind", "category", "court_id", "part_no", "text")


def outbox(blocks: DataFrame) -> DataFrame:
    """One JSON payload per message; a message has at most ``max_blocks`` blocks."""
    text = F.when(F.col("text").isNotNull(), F.struct(F.lit("mrkdwn").alias("type"), F.col("text").alias("text")))
    block = F.struct("block_no", F.struct(F.col("kind").alias("type"), text.alias("text")).alias("block"))
    ordered = F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"])
    return blocks.groupBy("message_no").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.to_json(F.struct(ordered.alias("blocks"))).alias("payload"))


def json_report(cases: DataFrame, cases_per_part: int = LINES_PER_PART) -> DataFrame:
    """Category → case string → object as JSON with sorted keys, in parts of bounded size.

    Parts of a category are consecutive ranges of its keys, so reading them in
    order gives all keys sorted. Only the keys are numbered and kept.
    """
    keys = number_rows(cases.select("category", "case_string"), ["category"], ["case_string"], "key_no")
    numbered = cases.join(keys, ["category", "case_string"]) \
        .withColumn("part_no", F.floor((F.col("key_no") - 1) / cases_per_part))
    fields = [c for c in ("absolute_url", "case_name", "category", "court_id", "description", "document_type",
                          "thing_searched") if c in cases.columns]
    entries = F.array_sort(F.collect_list(F.struct(F.col("case_string").alias("k"), F.struct(*fields).alias("v"))))
    body = F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})
    return numbered.groupBy("category", "part_no").agg(F.count(F.lit(1)).alias("n_cases"), body.alias("body"))
