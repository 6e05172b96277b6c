"""Queries: files written and read back through the readers under test."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docketflow import schemas
from docketflow.fixed_values import ARCHIVE_HOST, SEARCH_ALERT_CAP, SEARCH_CLASS_TYPE, SEARCH_ENTITY_TYPE
from docketflow.functions import spans as S
from docketflow.operators import corpus
from docketflow.operators.ordering import number_rows
from docketflow.plans import corpus_build, search_alert
from docketflow.plans.adapters import (
    MARKER_PAIR, annotations, docket, search_results, sentences, span_labels, table, with_views,
)
from docketflow.plans.queries_alerts import _SEARCH_FOUND, search_scorer, search_tagger
from docketflow.plans.queries_corpus import _ANNOTATED, _TOKEN
from docketflow.plans.queries_streaming import _warehouse
from docketflow.plans.registry import query
from docketflow.session import scratch_path
from docketflow.sources import corpora, tabular
from docketflow.sources.search_results import read_capped

SEARCH_DATE = dt.date(2000, 6, 1)
PAGE_KEYS = 400


# --- landed search pages ------------------------------------------------------------------------------------------

def _landed_pages(spark, d) -> str:
    """Search results as JSON pages, one folder per page; a page holds the results of a range of order keys."""
    result = F.struct("doc_order", "absolute_url", "caseName", "court_id", "description", F.col("date_filed").alias("dateFiled"))
    pages = search_results(spark, d).groupBy((F.floor(F.col("doc_order") / PAGE_KEYS) + 1).alias("page")) \
        .agg(F.sort_array(F.collect_list(result)).alias("results"))
    path = scratch_path(spark, "pages")
    pages.write.partitionBy("page").json(path)
    return path


_PAGES = f"""SELECT *, doc_order // {PAGE_KEYS} + 1 AS page_no,
  row_number() OVER (PARTITION BY doc_order // {PAGE_KEYS} ORDER BY doc_order) - 1 AS pos FROM search_results"""


@query("search_pages_read", with_views("search_results", """
SELECT page_no, pos, absolute_url, caseName, court_id, description, date_filed AS "dateFiled" FROM pages""", pages=_PAGES))
def search_pages_read(spark, d):
    """All landed pages, without a cap."""
    return read_capped(spark, _landed_pages(spark, d)).withColumn("pos", F.col("pos").cast("bigint")).drop("page_path")


@query("search_pages_capped", with_views("search_results", f"""
SELECT page_no, pos, absolute_url FROM pages WHERE page_no IN (SELECT page_no FROM sizes WHERE before <= {SEARCH_ALERT_CAP})""",
                                         pages=_PAGES, sizes="""SELECT page_no,
  sum(count(*)) OVER (ORDER BY page_no) - count(*) AS before FROM pages GROUP BY 1"""))
def search_pages_capped(spark, d):
    """Pages up to the one that exceeds the cap: the cap is the operator."""
    rows = read_capped(spark, _landed_pages(spark, d), SEARCH_ALERT_CAP)
    return rows.select("page_no", F.col("pos").cast("bigint").alias("pos"), "absolute_url")


def _sql_search_run(cap: int) -> dict[str, str]:
    return {
        "pages": _PAGES,
        "hits": f"""SELECT *, page_no * 1000000 + pos AS place FROM pages WHERE contains(lower(description), 'search warrant')
          AND date_filed >= TIMESTAMP '{SEARCH_DATE}' - INTERVAL 800 DAY""",
        "sized": "SELECT page_no, sum(count(*)) OVER (ORDER BY page_no) - count(*) AS before FROM hits GROUP BY 1",
        "scored": f"""SELECT * EXCLUDE (absolute_url, doc_order), place AS doc_order,
          '{ARCHIVE_HOST}' || absolute_url AS absolute_url, (description ILIKE '%warrant%')::int AS predicted_class
          FROM hits WHERE page_no IN (SELECT page_no FROM sized WHERE before <= {cap})""",
        "found": _SEARCH_FOUND, "entities": "SELECT * FROM found WHERE NOT starts_with(category, 'L-')",
    }


_RUN_RESULT = f"""
SELECT absolute_url, '{SEARCH_CLASS_TYPE}' AS prediction_type, '1' AS prediction_value, NULL AS prediction_substring FROM scored
UNION ALL SELECT absolute_url, '{SEARCH_ENTITY_TYPE}', category, thing_searched FROM entities"""


@query("search_alert_run", with_views("search_results", _RUN_RESULT, **_sql_search_run(100)))
def search_alert_run(spark, d):
    """Landed pages to logs: phrase, lookback, page cap, unseen, scored, logged, reported; a second run adds nothing."""
    warehouse, root, path = _warehouse(spark), scratch_path(spark, "search"), _landed_pages(spark, d)
    for run in ("first", "second"):
        found = search_alert.landed_results(spark, path, SEARCH_DATE, cap=100)
        search_alert.publish(found, warehouse, search_scorer, search_tagger, root, run, 0)
    classes = warehouse.table("courtlistener_predictions").read().select(
        "absolute_url", "prediction_type", F.col("prediction_value").cast("int").cast("string").alias("prediction_value"),
        F.lit(None).cast("string").alias("prediction_substring"))
    return classes.unionByName(warehouse.table("courtlistener_ner_predictions").read().select(*classes.columns))


# --- corpora ------------------------------------------------------------------------------------------------------

@query("label_tool_export", with_views("raw_tags", """
SELECT pos, token, tag, count(*) AS n FROM raw_tags GROUP BY 1, 2, 3"""))
def label_tool_export(spark, d):
    """Sentences as a label tool writes them, with marker lines and blank examples, and tags with inner blanks."""
    path = scratch_path(spark, "export")
    lines = F.transform(F.arrays_zip(F.col("words").alias("w"), F.col("tags").alias("t")),
                        lambda p: F.concat(p["w"], F.lit(" -X- _ "), p["t"]))
    body = F.concat(F.lit("-DOCSTART- -X- O O\n"), F.array_join(lines, "\n"), F.lit("\n\n-DOCSTART- -X- O O\n"))
    sentences(spark, d).select(body.alias("value")).write.option("lineSep", "\n\n").text(path)
    rows = corpora.token_rows(corpora.read_label_tool_export(spark, path))
    return rows.groupBy("pos", "token", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("sentence_keys", """SELECT true AS same, true AS all_read""")
def sentence_keys(spark, d):
    """One corpus in files of two packings: the same sentences have the same keys, and so the same splits.

    One packing is in as few files as their size allows, a single one for a small corpus; the other in five or more.
    """
    tagged = corpus.repaired_export(sentences(spark, d)).withColumn("split", F.lit("all"))
    keys = []
    many = max(5, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for packed in (tagged.hint("rebalance"), tagged.repartition(many)):
        path = scratch_path(spark, "corpus")
        corpora.write_corpus(packed, path)
        keys.append(corpora.read_corpus(spark, path).groupBy(F.col("sent_id").alias("k"), corpus.split_name(F.col("sent_id"))
                                                              .alias("s")).agg(F.count(F.lit(1)).alias("n")))
    differ = keys[0].exceptAll(keys[1]).unionByName(keys[1].exceptAll(keys[0])).agg(F.count(F.lit(1)).alias("n"))
    read = keys[0].agg(F.sum("n").alias("n"))
    total = tagged.where(F.size("words") > 0).agg(F.count(F.lit(1)).alias("n"))
    rows = differ.withColumn("x", F.lit("differ")).unionByName(read.withColumn("x", F.lit("read"))) \
        .unionByName(total.withColumn("x", F.lit("total"))).groupBy().pivot("x", ["differ", "read", "total"]).agg(F.first("n"))
    return rows.select((F.col("differ") == 0).alias("same"), (F.col("read") == F.col("total")).alias("all_read"))


@query("annotation_files", with_views("spans", f"SELECT split, variant, {_TOKEN} FROM annotated", **_ANNOTATED))
def annotation_files(spark, d):
    """Annotated examples written as JSON lines under their key, read back and built into the corpus, with labels from CSV."""
    path, labels = scratch_path(spark, "annotations"), scratch_path(spark, "labels")
    annotations(spark, d).withColumnRenamed("sent_id", "id").write.json(path)
    tabular.write_csv(span_labels(spark), labels)
    known = tabular.read_csv(spark, labels, schemas.TOKEN_LABEL)
    built = corpus_build.from_annotations(corpora.read_annotations(spark, path), "sent_id", known, MARKER_PAIR)
    return corpora.token_rows(built, "split", "variant")


@query("token_labels_read", with_views("spans", """
SELECT text AS token, upper(replace(max(class), ' ', '_')) AS label FROM spans GROUP BY 1"""))
def token_labels_read(spark, d):
    """Span texts and their classes as CSV; of repeated tokens the last row, here the greatest class, counts."""
    found = sentences(spark, d).select(F.explode(S.decode_spans(F.col("words"), F.col("tags"))).alias("s"))
    path = scratch_path(spark, "token-labels")
    rows = found.select(F.col("s.text").alias("token"), F.col("s.tag").alias("label")).distinct()
    tabular.write_csv(number_rows(rows, [], ["label", "token"], "row_no"), path)
    return tabular.read_token_labels(spark, path, numbered=True)


# --- CSV ----------------------------------------------------------------------------------------------------------

@query("csv_roundtrip", """
SELECT item_id::varchar AS token, 'a "quoted", ' || chr(10) || text || '"' AS label FROM benchmark
UNION ALL SELECT doc_id::varchar, text FROM documents""")
def csv_roundtrip(spark, d):
    """Quotes, commas and line breaks survive writing and reading."""
    quoted = F.concat(F.lit('a "quoted", \n'), "text", F.lit('"'))
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("token"), quoted.alias("label")) \
        .unionByName(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("token"), F.col("text").alias("label")))
    path = scratch_path(spark, "csv")
    tabular.write_csv(rows, path)
    return tabular.read_csv(spark, path, schemas.TOKEN_LABEL)


@query("press_releases_read", """
SELECT '2020-01-0' || (page_id % 9 + 1) AS date, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  url AS doc_url, url || '/host' AS host_url FROM pages""")
def press_releases_read(spark, d):
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("2020-01-0"), (F.col("page_id") % 9 + 1).cast("string")).alias("date"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("url").alias("doc_url"),
        F.concat("url", F.lit("/host")).alias("host_url"))
    path = scratch_path(spark, "press")
    tabular.write_csv(pages, path)
    return tabular.read_press_releases(spark, path)


@query("labelled_dockets_read", with_views("docket", """
SELECT entry_id::int AS row_no, case_name, document_type, case_number, court, document_type ILIKE '%search%' AS is_search_warrant
FROM docket"""))
def labelled_dockets_read(spark, d):
    rows = docket(spark, d).select(
        F.col("entry_id").cast("int").alias("row_no"), "case_name", "document_type", "case_number", "court",
        F.col("document_type").ilike("%search%").alias("is_search_warrant"))
    path = scratch_path(spark, "labelled")
    tabular.write_csv(rows, path)
    return tabular.read_labelled_dockets(spark, path)
