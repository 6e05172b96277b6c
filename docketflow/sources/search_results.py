"""Landed pages of document-search results and the searches over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow import schemas
from docketflow.fixed_values import SEARCH_PHRASE
from docketflow.functions.parse import query_parameter
from docketflow.operators.ordering import running_total

_PAGE_IN_PATH = r"page[=_-]?(\d+)(?!.*page[=_-]?\d)"
_LAST = 2**40


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed page: ``page_no, page_path, results, next``.

    The number is the last one in the page's path, or that before the page its
    ``next`` address asks for. A page with neither comes after all others.
    """
    pages = spark.read.schema(schemas.SEARCH_PAGE).json(path, multiLine=True)
    file = F.col("_metadata.file_path")
    number = F.coalesce(F.regexp_extract(file, _PAGE_IN_PATH, 1).try_cast("bigint"),
                        query_parameter(F.col("next"), "page").try_cast("bigint") - 1, F.lit(_LAST))
    return pages.select(number.alias("page_no"), file.alias("page_path"), "results", "next")


def unnumbered_pages(pages: DataFrame) -> DataFrame:
    """Pages whose place is unknown; they are read all the same, last."""
    return pages.where(F.col("page_no") == _LAST).select("page_path")


def explode_pages(pages: DataFrame) -> DataFrame:
    """Search results in page order; a page without results gives none."""
    rows = pages.select("page_no", "page_path", F.posexplode("results").alias("pos", "r"))
    return rows.select("page_no", "page_path", "pos", "r.*")


def kept_pages(page_sizes: DataFrame, cap: int) -> DataFrame:
    """Pages a reader fetches that stops once it holds more than ``cap`` records.

    Page k is kept while the pages before it hold at most ``cap`` records, so
    whole pages are kept and the total overshoots. ``page_sizes``: page_no, n_records
    and, where numbers may repeat, page_path.
    """
    order = [c for c in ("page_no", "page_path") if c in page_sizes.columns]
    totals = running_total(page_sizes, [], order, F.col("n_records"), "records_so_far")
    before = F.col("records_so_far") - F.col("n_records")
    return totals.withColumn("records_before", before).where(F.col("records_before") <= cap)


def read_capped(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Results of landed pages; with ``cap`` only of the pages up to the one that exceeds it."""
    pages = read_search_pages(spark, path)
    if cap is None:
        return explode_pages(pages)
    sizes = pages.select("page_no", "page_path", F.coalesce(F.size("results"), F.lit(0)).alias("n_records"))
    kept = kept_pages(sizes, cap).select("page_no", "page_path")
    return explode_pages(pages.join(kept, ["page_no", "page_path"], "left_semi"))


def matches_terms(text: Column, query: str) -> Column:
    """Every word of ``query`` occurs as a word of ``text``, in any order and case."""
    hit = F.lit(True)
    for word in query.split():
        hit = hit & text.rlike(rf"(?i)(^|[^A-Za-z0-9_]){word}([^A-Za-z0-9_]|$)")
    return hit


def matches_phrase(text: Column, phrase: str) -> Column:
    return F.contains(F.lower(text), F.lit(phrase.lower()))


def search(
    documents: DataFrame, *, q: str | None = None, description: str | None = None, filed_after=None,
    available_only: bool | None = None, suit_nature: str | None = None, n: int | None = None,
) -> DataFrame:
    """Documents that pass the given filters, newest first.

    Needs description, date_filed, doc_order; case_name, is_available and
    suit_nature where their filters are used. ``n`` is an exact top-n.
    """
    found = documents
    if available_only:
        found = found.where(F.col("is_available"))
    if filed_after is not None:
        found = found.where(F.col("date_filed") >= F.lit(filed_after))
    if suit_nature is not None:
        found = found.where(F.col("suit_nature") == suit_nature)
    if description is not None:
        found = found.where(matches_phrase(F.col("description"), description))
    if q is not None:
        found = found.where(matches_terms(F.concat_ws(" ", "case_name", "description"), q))
    ordering = [F.desc("date_filed"), F.asc("doc_order")]
    # Only a top-n needs an order here; a full sort is the sink's business.
    return found.orderBy(*ordering).limit(n) if n is not None else found


def search_by_description(documents: DataFrame, phrase: str = SEARCH_PHRASE, **filters) -> DataFrame:
    return search(documents, description=phrase, **filters)


def search_by_keywords(
    documents: DataFrame, queries: tuple[str, ...] = ("search warrant", "seizure warrant"),
    distinct: bool = False, **filters,
) -> DataFrame:
    """Results of several searches after one another; a document found twice appears twice.

    Without a top-n the searches share one scan: each row is repeated once per query it matches.
    """
    if filters.get("n") is not None:
        found = None
        for query in queries:
            part = search(documents, q=query, **filters).withColumn("matched_query", F.lit(query))
            found = part if found is None else found.unionByName(part)
    else:
        text = F.concat_ws(" ", "case_name", "description")
        hits = F.array_compact(F.array(*[F.when(matches_terms(text, q), F.lit(q)) for q in queries]))
        found = search(documents, **filters).withColumn("matched_query", F.explode(hits))
    return found.dropDuplicates(["doc_order"]).drop("matched_query") if distinct else found
