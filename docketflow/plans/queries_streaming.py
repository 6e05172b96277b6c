"""Queries: streams over landed files, file round trips and table creation."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow import schemas
from docketflow.fixed_values import FEED_CLASS_TYPE
from docketflow.functions import parse
from docketflow.operators import select, state
from docketflow.operators.corpus import repaired_export
from docketflow.plans.adapters import docket, docket_raw, predictions, search_results, sentences, table, with_views
from docketflow.plans.queries_alerts import feed_scorer, feed_tagger
from docketflow.plans.queries_feed import DOCKET_COLUMNS, START, _SQL_CANDIDATE, _SQL_SEEN
from docketflow.plans.registry import ORACLES, query
from docketflow.session import scratch_path
from docketflow.sources import corpora, feeds
from docketflow.sources.tables import Table, Warehouse, staged
from docketflow.streaming import alerts, ingest


def _landed(df, label: str) -> str:
    """Write rows as the files of a landing folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", 20_000).parquet(path)
    return path


def _stream(spark, path: str):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", ingest.files_per_batch(spark, path, 2)).parquet(path)


def _warehouse(spark, parts: int = 1) -> Warehouse:
    path = scratch_path(spark, "warehouse")
    return Warehouse(spark, "docketflow_" + path[-32:], path, parts)


def _keyed_events(spark, d):
    return table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id",
                                            "ts", "event_type", "value")


def _latest_events(spark, events):
    """Stream events into a table of the newest event by user and day; the table and the path of rejected rows."""
    path = scratch_path(spark, "latest")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS docketflow_{path[-32:]} LOCATION '{path}'")
    fields = [f for f in events.schema.fields if f.name != "day"]
    target = Table(spark, f"docketflow_{path[-32:]}.latest", T.StructType(fields),
                   {"day": "date_format(ts, 'yyyy-MM-dd')"}).create()
    rejects = scratch_path(spark, "rejects")
    ingest.start_upsert(_stream(spark, _landed(events, "events")), target, ["user_id", "day"], ["ts", "event_id"],
                        rejects, scratch_path(spark, "offsets")).awaitTermination()
    return target, rejects


@query("stream_upsert", ORACLES["upsert_latest"])
def stream_upsert(spark, d):
    return _latest_events(spark, _keyed_events(spark, d))[0].read()


@query("upsert_rejects", """
WITH e AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id,
  strftime(ts, '%Y-%m-%d') AS day, event_id, ts FROM events)
SELECT 'rejected' AS fate, event_id, day FROM e WHERE user_id IS NULL
UNION ALL SELECT 'kept', event_id, day FROM (SELECT * FROM e WHERE user_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1)""")
def upsert_rejects(spark, d):
    """Events of one kind arrive without a user; the upsert sets them aside and loses none."""
    events = _keyed_events(spark, d).withColumn("user_id", F.when(F.col("event_type") != "error", F.col("user_id")))
    target, rejects = _latest_events(spark, events)
    kept = target.read().select(F.lit("kept").alias("fate"), "event_id", "day")
    return kept.unionByName(spark.read.parquet(rejects).select(F.lit("rejected").alias("fate"), "event_id", "day"))


@query("stream_candidates", with_views("docket predictions", f"""
SELECT DISTINCT case_number, pub_date, 'candidate' AS prediction_type FROM docket k
WHERE {_SQL_CANDIDATE} AND pub_date > TIMESTAMP '{START}' AND NOT EXISTS ({_SQL_SEEN} AND
  p.prediction_type = 'swornot')"""))
def stream_candidates(spark, d):
    warehouse = _warehouse(spark)
    alerts.start_candidates(_stream(spark, _landed(docket(spark, d), "docket")), predictions(spark, d), START, warehouse,
                            scratch_path(spark, "offsets")).awaitTermination()
    return warehouse.table("predictions").read().select(*schemas.DOCKET_KEY, "prediction_type")


_ONE_PER_KEY = """SELECT * FROM docket QUALIFY row_number() OVER (PARTITION BY case_number, pub_date ORDER BY entry_id DESC) = 1"""
_UNIQUE_SCORED = f"""SELECT *, (document_type ILIKE '%warrant%' OR case_name ILIKE '%warrant%') AS positive,
  regexp_matches(case_name, 'Black phone|One parcel|Silver car') AS found FROM single
  WHERE {_SQL_CANDIDATE} AND pub_date > TIMESTAMP '{START}' AND case_name IS NOT NULL"""


def _one_per_key(spark, d):
    return state.latest_per_key(docket(spark, d), schemas.DOCKET_KEY, "entry_id")


@query("stream_feed_alert", with_views("docket", """
SELECT case_number, pub_date, case_name, positive AS prediction_value, CASE WHEN positive THEN 1 ELSE 0 END AS n_entities,
  CASE WHEN positive AND found THEN 1 ELSE 0 END AS n_named FROM scored""", single=_ONE_PER_KEY, scored=_UNIQUE_SCORED))
def stream_feed_alert(spark, d):
    """The feed run over landed entries: what is left in the docket after the purges, and what the logs say of it."""
    warehouse, path = _warehouse(spark), _landed(_one_per_key(spark, d).select(*schemas.DOCKET.names), "entries")
    alerts.run_feed(_stream(spark, path), START, feed_scorer, feed_tagger, warehouse, scratch_path(spark, "alerts"),
                    scratch_path(spark, "offsets"))
    classes = warehouse.table("predictions").read().select(*schemas.DOCKET_KEY, "prediction_value")
    entities = warehouse.table("ner_predictions").read().groupBy(*schemas.DOCKET_KEY).agg(
        F.count(F.lit(1)).alias("n_entities"), F.count("prediction_substring").alias("n_named"))
    return warehouse.table("rss_docket_entries").read().select(*schemas.DOCKET_KEY, "case_name") \
        .join(classes, schemas.DOCKET_KEY, "left").join(entities, schemas.DOCKET_KEY, "left") \
        .na.fill(0, ["n_entities", "n_named"])


@query("feed_run_empty", with_views("docket", f"""
SELECT case_number, pub_date, case_name FROM single WHERE NOT coalesce({_SQL_CANDIDATE}, false)""", single=_ONE_PER_KEY))
def feed_run_empty(spark, d):
    """A run without a candidate scores, sends and purges nothing: the docket keeps all entries."""
    warehouse, root = _warehouse(spark), scratch_path(spark, "alerts")
    entries = _one_per_key(spark, d).where(~F.coalesce(select.is_candidate(F.col("document_type")), F.lit(False)))
    path = _landed(entries.select(*schemas.DOCKET.names), "entries")
    alerts.run_feed(_stream(spark, path), START, feed_scorer, feed_tagger, warehouse, root, scratch_path(spark, "offsets"))
    logged = warehouse.table("predictions").read().select(*schemas.DOCKET_KEY, F.lit("logged").alias("case_name"))
    return warehouse.table("rss_docket_entries").read().select(*schemas.DOCKET_KEY, "case_name").unionByName(logged)


@query("log_after_restart", with_views("docket", f"""
SELECT md5(case_number || '|' || strftime(pub_date, '%Y-%m-%d %H:%M:%S') || '|{FEED_CLASS_TYPE}') AS log_key,
  case_number, pub_date, positive AS prediction_value FROM scored""", single=_ONE_PER_KEY, scored=_UNIQUE_SCORED))
def log_after_restart(spark, d):
    """Two runs with checkpoints of their own over different files; both number their batches from 0."""
    warehouse, root = _warehouse(spark), scratch_path(spark, "alerts")
    entries, _ = staged(_one_per_key(spark, d), "docket")   # both runs take theirs from it
    for part in (F.col("court") < "c2", F.col("court") >= "c2"):
        stream = _stream(spark, _landed(entries.where(part), "entries"))
        alerts.start_feed_alert(stream, START, "entry_id", feed_scorer, feed_tagger, warehouse, root,
                                scratch_path(spark, "offsets")).awaitTermination()
    return warehouse.table("predictions").read().select("log_key", *schemas.DOCKET_KEY, "prediction_value")


def _landed_feeds(spark, d) -> str:
    """Entries as feed XML per court; snapshots hold one entry of a key, and a court's entries may lie in several files."""
    newest = state.latest_per_key(docket_raw(spark, d).withColumn("case_number", parse.case_number(F.col("title"))),
                                  schemas.DOCKET_KEY, "entry_id")
    raw = newest.select(
        "court", "title", "link", "description", "guid",
        F.concat(F.date_format("pub_date", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("pubDate"))
    path = scratch_path(spark, "feeds")
    raw.hint("rebalance", F.col("court")).write.format("xml") \
        .option("rootTag", "channel").option("rowTag", "item").partitionBy("court").save(path)
    return path


@query("feed_snapshots_read", with_views("docket_raw", """
SELECT title, link, trim(description) AS description, guid, court FROM docket_raw
QUALIFY row_number() OVER (PARTITION BY split_part(title, ' ', 1), pub_date ORDER BY entry_id DESC) = 1"""))
def feed_snapshots_read(spark, d):
    """Landed snapshots as they are; reading a feed drops the blanks around an element's text."""
    return feeds.read_feed_snapshots(spark, _landed_feeds(spark, d)).select("title", "link", "description", "guid", "court")


@query("feed_file_ingest", with_views("docket", f"""
SELECT {DOCKET_COLUMNS.replace(', scrape_date', '').replace('description', 'trim(description) AS description')} FROM docket
QUALIFY row_number() OVER (PARTITION BY case_number, pub_date ORDER BY entry_id DESC) = 1"""))
def feed_file_ingest(spark, d):
    """Landed snapshots streamed into the docket table."""
    target = _warehouse(spark).table("rss_docket_entries")
    ingest.start_ingest(feeds.stream_feed_snapshots(spark, _landed_feeds(spark, d)), target, scratch_path(spark, "quarantine"),
                        scratch_path(spark, "offsets")).awaitTermination()
    return target.read().select(*[c for c in schemas.DOCKET.names if c != "scrape_date"])


@query("file_roundtrips", with_views("classed", """
SELECT pos, token, tag, count(*) AS n FROM (SELECT pos, token, CASE WHEN class IS NULL THEN 'O' ELSE
  upper(replace(CASE WHEN NOT goes_on THEN 'B-' WHEN is_continued THEN 'I-' ELSE 'E-' END || class, ' ', '_')) END
  AS tag FROM classed) GROUP BY 1, 2, 3"""))
def file_roundtrips(spark, d):
    """Repaired sentences written as a corpus and read back."""
    path = scratch_path(spark, "corpus")
    corpora.write_corpus(repaired_export(sentences(spark, d)).withColumn("split", F.lit("all")), path)
    rows = corpora.token_rows(corpora.read_corpus(spark, path))
    return rows.groupBy("pos", "token", "tag").agg(F.count(F.lit(1)).alias("n"))


_SQL_CREATED = """
SELECT 'rss_docket_entries' AS table_name, count(*) AS n_rows, count(DISTINCT case_number) AS n_keys FROM docket
UNION ALL SELECT 'predictions', count(*), count(DISTINCT case_number) FROM logged
UNION ALL SELECT 'ner_predictions', count(*), count(DISTINCT case_number) FROM logged
UNION ALL SELECT 'courtlistener_predictions', count(*), count(DISTINCT absolute_url) FROM search_results
UNION ALL SELECT 'courtlistener_ner_predictions', count(*), count(DISTINCT absolute_url) FROM search_results"""


@query("tables_created", with_views("docket search_results", _SQL_CREATED,
                                    logged="SELECT DISTINCT case_number, pub_date FROM docket"))
def tables_created(spark, d):
    """Create all tables of a new warehouse, write rows to each and read them back."""
    tables = _warehouse(spark).tables()
    entries = docket(spark, d)
    target = tables["rss_docket_entries"]
    target.replace(entries, target.touched(target.placed(entries)))
    made = [F.lit(v).alias(c) for c, v in {"predicted_class": 1, "likelihood": 1.0, "span_pos": 0, "category": "CAR",
                                           "thing_searched": "car"}.items()]
    scored, _ = staged(entries.select(*schemas.DOCKET_KEY, *made), "scored")   # each is appended four times
    found, _ = staged(search_results(spark, d).select("absolute_url", *made), "found")
    for prefix, rows, keys in (("", scored, schemas.DOCKET_KEY), ("courtlistener_", found, ["absolute_url"])):
        for _ in range(2):   # what is logged twice stays logged once
            tables[f"{prefix}predictions"].append(state.class_log_rows(rows, keys, FEED_CLASS_TYPE), "log_key")
            tables[f"{prefix}ner_predictions"].append(state.entity_log_rows(rows, keys, FEED_CLASS_TYPE), "log_key")

    def counts(name, key):
        return tables[name].read().agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                                       F.countDistinct(key).alias("n_keys"))
    rows = [counts(name, "absolute_url" if name.startswith("courtlistener") else "case_number") for name in tables]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)
