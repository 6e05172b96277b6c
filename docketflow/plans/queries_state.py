"""Queries: state-store streams, key sketches, nested children, write checks, run counts and a large dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.fixed_values import FEED_ENTITY_TYPE, SEARCH_CLASS_TYPE
from docketflow.functions import parse
from docketflow.functions.text import let, match_form
from docketflow.operators import automaton, digest, gate, select, state, tagging
from docketflow.plans import feed_alert, search_alert
from docketflow.plans.adapters import docket, predictions, search_results, table, with_views
from docketflow.plans.queries_alerts import (
    _CASES, _SEARCH_FOUND, _SQL_FORMS, _span_rows, _sql_fold, feed_scorer, feed_tagger, search_scorer, search_tagger,
)
from docketflow.plans.queries_feed import START, _SQL_CANDIDATE, RUN_DATE
from docketflow.plans.queries_files import SEARCH_DATE
from docketflow.plans.queries_streaming import _ONE_PER_KEY, _keyed_events, _landed, _landed_feeds, _stream, _warehouse
from docketflow.plans.registry import ORACLES, query
from docketflow.schemas import DOCKET, DOCKET_KEY
from docketflow.session import scratch_path
from docketflow.sources import feeds
from docketflow.sources.tables import Table
from docketflow.streaming import ingest
from docketflow.streaming import state as stream_state

# --- streams with state -------------------------------------------------------------------------------------------

PERIOD_DAYS = 6


def _utc(time):
    """A time without zone as the instant at which clocks in UTC show it, whatever the session's zone is."""
    return F.to_utc_timestamp(time.cast("timestamp"), F.current_timezone())


def _wall(time):
    return F.from_utc_timestamp(time, F.current_timezone()).cast("timestamp_ntz")


def _in_periods(spark, events, start) -> None:
    """Land events period by period of their time, and run ``start(stream)`` over each; all runs share a checkpoint."""
    path = scratch_path(spark, "events")
    period = F.floor(F.datediff("ts", F.lit("1970-01-01")) / PERIOD_DAYS)
    for (number,) in events.select(period.alias("p")).distinct().orderBy("p").collect():
        events.where(period == number).write.mode("append").parquet(path)
        start(spark.readStream.schema(events.schema).parquet(path)).awaitTermination()


@query("stream_latest_state", ORACLES["upsert_latest"])
def stream_latest_state(spark, d):
    """The newest event of each user and day from the state store, in update mode; two runs, the second one resumes."""
    events, path = _keyed_events(spark, d), scratch_path(spark, "events")
    folder = scratch_path(spark, "latest")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS docketflow_{folder[-32:]} LOCATION '{folder}'")
    target = Table(spark, f"docketflow_{folder[-32:]}.latest", T.StructType([f for f in events.schema.fields if f.name != "day"]),
                   {"day": "date_format(ts, 'yyyy-MM-dd')"}).create()
    checkpoint = scratch_path(spark, "offsets")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.option("maxRecordsPerFile", 20_000).mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema) \
            .option("maxFilesPerTrigger", ingest.files_per_batch(spark, path, 3)).parquet(path)
        stream_state.start_latest(stream, target, ["user_id", "day"], ["ts", "event_id"], checkpoint).awaitTermination()
    return target.read()


@query("stream_view_by_type", """
SELECT event_type, count(*) AS n_events, sum(event_id)::bigint AS id_sum, min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY 1""")
def stream_view_by_type(spark, d):
    """Totals of each kind of event, written whole after every batch in complete mode."""
    path, checkpoint = scratch_path(spark, "view"), scratch_path(spark, "offsets")

    def start(stream):
        view = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("event_id").alias("id_sum"),
                                                F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        return stream_state.start_view(view, path, checkpoint)
    _in_periods(spark, table(spark, d, "events").select("event_type", "event_id", "ts"), start)
    return stream_state.read_view(spark, path)


@query("stream_closed_days", """
SELECT date_trunc('day', ts)::timestamp AS day, event_type, count(*) AS n_events, max(event_id) AS last_id FROM events
GROUP BY 1, 2 HAVING date_trunc('day', ts)::timestamp + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_closed_days(spark, d):
    """Totals of each day, given out once, when the watermark, two days behind, has passed it; later days are still open."""
    path, checkpoint = scratch_path(spark, "days"), scratch_path(spark, "offsets")

    def start(stream):
        days = stream_state.closed_windows(stream.withColumn("at", _utc(F.col("ts"))), "at", "1 day", "2 days", ["event_type"],
                                           n_events=F.count(F.lit(1)), last_id=F.max("event_id"))
        return stream_state.start_append(days, path, checkpoint)
    _in_periods(spark, table(spark, d, "events").select("event_type", "event_id", "ts"), start)
    return spark.read.parquet(path).select(_wall(F.col("window_start")).alias("day"), "event_type", "n_events", "last_id")


SEEN_DELAY_DAYS = 5

_FIRST_SEEN = f"""
WITH e AS (SELECT DISTINCT user_id, event_type, period, day, open_since FROM (SELECT user_id, event_type, date_trunc('day', ts)::timestamp AS day,
    datediff('day', DATE '1970-01-01', ts::date) // {PERIOD_DAYS} AS period FROM events)
  JOIN (SELECT period, lag(newest) OVER (ORDER BY period) - INTERVAL {2 * SEEN_DELAY_DAYS} DAY AS open_since FROM (
    SELECT datediff('day', DATE '1970-01-01', ts::date) // {PERIOD_DAYS} AS period, max(date_trunc('day', ts)::timestamp) AS newest
    FROM events GROUP BY 1)) USING (period)),
f AS (SELECT user_id, event_type, period, min(day) AS day, any_value(open_since) AS open_since FROM e GROUP BY 1, 2, 3),
l AS (SELECT user_id, event_type, list({{'d': day, 'o': open_since}} ORDER BY period) AS xs FROM f GROUP BY 1, 2),
k AS (SELECT user_id, event_type, unnest(list_reduce(xs[2:], lambda acc, x: CASE WHEN acc[-1].d <= x.o THEN list_append(acc, x)
  ELSE acc END, [xs[1]])) AS x FROM l)
SELECT user_id, event_type, x.d AS day FROM k"""


@query("stream_first_seen", _FIRST_SEEN)
def stream_first_seen(spark, d):
    """Kinds of event of each user that were not seen within five days, counted by days, from state that expires.

    A key's row survives when the watermark, five days behind the newest day of the periods before, has reached the day
    of the row that was let through last plus five days. Each period lands its oldest day of a key first.
    """
    path, checkpoint = scratch_path(spark, "seen"), scratch_path(spark, "offsets")
    period = F.floor(F.datediff("ts", F.lit("1970-01-01")) / PERIOD_DAYS)
    events = table(spark, d, "events").groupBy("user_id", "event_type", period.alias("period")) \
        .agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("ts"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("newest"))
    # The newest day of a period moves the watermark, so it is landed too, under a key of its own for each period.
    newest = events.groupBy("period").agg(F.max("newest").alias("ts")) \
        .select(F.lit(None).cast("long").alias("user_id"), F.col("period").cast("string").alias("event_type"), "ts")
    landed = events.select("user_id", "event_type", "ts").unionByName(newest)

    def start(stream):
        rows = stream_state.first_seen(stream.withColumn("at", _utc(F.col("ts"))), ["user_id", "event_type"], "at", f"{SEEN_DELAY_DAYS} days")
        return stream_state.start_append(rows.drop("at"), path, checkpoint)
    _in_periods(spark, landed, start)
    return spark.read.parquet(path).where(F.col("user_id").isNotNull()).select("user_id", "event_type", F.col("ts").alias("day"))


#: Entries whose two scrapes one task lands.
ROWS_A_WRITER = 250_000


@query("stream_docket_repeats", with_views("docket", """
SELECT case_number, pub_date, case_name, scrape_date + INTERVAL (entry_id) SECOND AS scrape_date FROM docket
QUALIFY row_number() OVER (PARTITION BY case_number, pub_date ORDER BY entry_id DESC) = 1"""))
def stream_docket_repeats(spark, d):
    """Every entry is landed twice, the later scrape anywhere among the files, and keys repeat; months are split by key."""
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("entry_id").cast("decimal(18,6)"))
    entries = docket(spark, d)
    files = max(8, -(-entries.count() // ROWS_A_WRITER))
    # The docket is parsed once: each entry gives both of its scrapes.
    both = entries.withColumn("stale", F.explode(F.array(F.lit(False), F.lit(True))))
    landed = both.withColumns({
        "scrape_date": F.col("scrape_date") + seconds - F.when(F.col("stale"), F.expr("interval 2 days")).otherwise(F.expr("interval 0 days")),
        "case_name": F.when(F.col("stale"), "stale").otherwise(F.col("case_name"))})
    target = _warehouse(spark, 2).table("rss_docket_entries")
    path = _landed(landed.select(*DOCKET.names).repartition(files, F.xxhash64("guid", "scrape_date")), "entries")
    ingest.start_docket(_stream(spark, path), target, scratch_path(spark, "offsets")).awaitTermination()
    return target.read().select(*DOCKET_KEY, "case_name", "scrape_date")


# --- logs with a key sketch ---------------------------------------------------------------------------------------

@query("unseen_by_sketch", ORACLES["unseen_urls"])
def unseen_by_sketch(spark, d):
    """Documents whose address is not in the log, which is opened only where its sketch says that it may hold one."""
    path = F.concat(F.lit("/doc/"), F.col("doc_id").cast("string"), F.lit("/"))
    log = _warehouse(spark).table("courtlistener_predictions")
    sketch = log.sketch()
    scored = table(spark, d, "labels").select(parse.absolute_url(path).alias("absolute_url"), F.lit(1).alias("predicted_class"),
                                              F.lit(1.0).alias("likelihood"))
    log.append(state.class_log_rows(scored, ["absolute_url"], SEARCH_CLASS_TYPE), "log_key")
    found = table(spark, d, "documents").select("doc_id", path.alias("absolute_url"))
    return sketch.unseen(select.addressed(found))


@query("candidates_by_sketch", ORACLES["lookback"])
def candidates_by_sketch(spark, d):
    """Candidates without a row of any type in the log, whose sketch is made from the rows it holds."""
    log = _warehouse(spark).table("predictions")
    scored = predictions(spark, d).select(*DOCKET_KEY, F.lit(1).alias("predicted_class"), F.lit(1.0).alias("likelihood"))
    log.append(state.class_log_rows(scored, DOCKET_KEY, "any"), "log_key")
    wanted = select.since(docket(spark, d), select.lookback_start(RUN_DATE, 800)).where(select.is_candidate(F.col("document_type")))
    return log.sketch().unseen(wanted).select("entry_id", *DOCKET_KEY)


# --- entries with their children ----------------------------------------------------------------------------------

CHILDREN = 5
_THING = """CASE WHEN contains(case_name, 'Black phone') THEN 'Black phone' WHEN contains(case_name, 'One parcel') THEN 'One parcel'
  WHEN contains(case_name, 'Silver car') THEN 'Silver car' END"""
_CATEGORY = """CASE WHEN contains(case_name, 'Black phone') THEN 'PHONE' WHEN contains(case_name, 'One parcel')
  THEN 'PACKAGE' WHEN contains(case_name, 'Silver car') THEN 'CAR' ELSE 'no category detected' END"""


@query("nested_children", with_views("docket predictions", """
SELECT entry_id, k.case_number, k.pub_date, coalesce(part_no, 0) AS part_no, coalesce(classes, '') AS classes,
  coalesce(entities, '') AS entities FROM docket k LEFT JOIN packed USING (case_number, pub_date)""",
    children=f"""SELECT case_number, pub_date, 0 AS kind, prediction_type AS t, prediction_value::varchar AS v, NULL AS s FROM predictions
      UNION ALL SELECT case_number, pub_date, 1, '{FEED_ENTITY_TYPE}', {_CATEGORY}, {_THING} FROM docket WHERE case_name IS NOT NULL""",
    numbered="""SELECT *, row_number() OVER (PARTITION BY case_number, pub_date ORDER BY kind, t, v, s NULLS FIRST) AS no FROM children""",
    packed=f"""SELECT case_number, pub_date, (no - 1) // {CHILDREN} AS part_no,
      string_agg(t || '=' || v, ',' ORDER BY no) FILTER (kind = 0) AS classes,
      string_agg(v || ':' || coalesce(s, '-'), ',' ORDER BY no) FILTER (kind = 1) AS entities FROM numbered GROUP BY 1, 2, 3"""))
def nested_children(spark, d):
    """Entries with their class and entity rows nested, in parts of five; the arrays are shown as text."""
    entries = docket(spark, d).select("entry_id", *DOCKET_KEY, "case_name", "court", "guid", "document_type")
    shaped = select.to_alert_shape(entries.where(F.col("case_name").isNotNull()), "entry_id", *DOCKET_KEY)
    tagged = tagging.entity_rows(shaped.withColumn("spans", tagging.dictionary_spans(F.col("description"), feed_alert.GAZETTEER)))
    entities = state.entity_log_rows(tagged, DOCKET_KEY, FEED_ENTITY_TYPE)
    nested = state.nested_children(entries.select("entry_id", *DOCKET_KEY), predictions(spark, d), entities, CHILDREN)
    classes = F.transform("classes", lambda r: F.concat(r["prediction_type"], F.lit("="), r["prediction_value"].cast("string")))
    things = F.transform("entities", lambda r: F.concat(r["prediction_value"], F.lit(":"), F.coalesce(r["prediction_substring"], F.lit("-"))))
    return nested.select("entry_id", *DOCKET_KEY, "part_no", F.array_join(classes, ",").alias("classes"),
                         F.array_join(things, ",").alias("entities"))


# --- checks at the write ------------------------------------------------------------------------------------------

@query("checked_append", with_views("docket", f"""
SELECT entry_id, coalesce(CASE WHEN rule IS NULL AND row_number() OVER (PARTITION BY rule IS NULL, case_number, pub_date
    ORDER BY entry_id) > 1 THEN '{gate.REPEATS}' ELSE rule END, 'accepted') AS verdict FROM judged
UNION ALL SELECT entry_id, 'in table' FROM held
UNION ALL SELECT * FROM (SELECT entry_id, 'in table' FROM judged WHERE rule IS NULL
  QUALIFY row_number() OVER (PARTITION BY case_number, pub_date ORDER BY entry_id) = 1)""",
    held="""SELECT * FROM docket WHERE entry_id % 10 = 3
      QUALIFY row_number() OVER (PARTITION BY case_number, pub_date ORDER BY entry_id) = 1""",
    batch="""SELECT entry_id, CASE WHEN entry_id % 97 <> 0 THEN case_number END AS case_number, pub_date, court FROM docket
      WHERE entry_id % 10 <> 3 UNION ALL SELECT -entry_id, case_number, pub_date, court FROM docket WHERE entry_id % 10 IN (3, 4)""",
    judged=f"""SELECT *, CASE WHEN case_number IS NULL THEN '{gate.NULL_KEY}'
      WHEN court NOT IN (SELECT 'c' || n_nationkey FROM nation WHERE n_nationkey < 20) THEN '{gate.NO_PARENT}'
      WHEN EXISTS (SELECT 1 FROM held h WHERE h.case_number = b.case_number AND h.pub_date = b.pub_date) THEN '{gate.EXISTS}'
      END AS rule FROM batch b"""))
def checked_append(spark, d):
    """Entries appended through the gate: repeats in the batch and against the table, orphans, keys with a null."""
    entries = docket(spark, d).withColumn("docket_entry_seq_num", F.col("entry_id").cast("int"))
    first = state.first_per_key(entries.where(F.col("entry_id") % 10 == 3), DOCKET_KEY, [F.asc("entry_id")])
    target = _warehouse(spark).table("rss_docket_entries")
    target.replace(first, target.partitions_of(first))
    number = F.col("entry_id")
    others = entries.where(number % 10 != 3).withColumn("case_number", F.when(number % 97 != 0, F.col("case_number")))
    again = entries.where((number % 10).isin(3, 4)).withColumns({"entry_id": -number, "docket_entry_seq_num": (-number).cast("int")})
    courts = table(spark, d, "nation").where(F.col("n_nationkey") < 20) \
        .select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("code"))
    judged = gate.append_checked(target, others.unionByName(again).select("entry_id", *DOCKET.names), DOCKET_KEY, ["entry_id"],
                                 scratch_path(spark, "verdicts"), courts, {"court": "code"})
    verdicts = judged.select("entry_id", F.coalesce(gate.RULE, F.lit("accepted")).alias("verdict"))
    return verdicts.unionByName(target.read().select(F.col("docket_entry_seq_num").cast("long").alias("entry_id"), F.lit("in table").alias("verdict")))


@query("run_counts", with_views("docket", f"""
SELECT count(*) AS n_rows, count(*) FILTER ({_SQL_CANDIDATE}) AS n_candidates,
  count(*) FILTER ({_SQL_CANDIDATE} AND pub_date > TIMESTAMP '{START}') AS n_recent,
  count(*) FILTER (entry_id % 13 = 0) AS n_blank,
  count(*) FILTER ({_SQL_CANDIDATE} AND pub_date > TIMESTAMP '{START}' AND case_name IS NOT NULL) AS n_scored,
  count(*) FILTER ({_SQL_CANDIDATE} AND pub_date > TIMESTAMP '{START}' AND case_name IS NOT NULL
    AND (document_type ILIKE '%warrant%' OR case_name ILIKE '%warrant%')) AS n_positive FROM docket"""))
def run_counts(spark, d):
    """What a feed run notes of itself while it writes its scores; every 13th description is blank."""
    blank = F.when(F.col("entry_id") % 13 == 0, F.lit(" \n")).otherwise(F.col("description"))
    root = scratch_path(spark, "alerts")
    feed_alert.publish(docket(spark, d).withColumn("description", blank), _warehouse(spark), START, "entry_id", feed_scorer, feed_tagger,
                       root, "run", 0)
    return spark.read.parquet(f"{root}/counts").select(*feed_alert.COUNTS)


# --- a large dictionary -------------------------------------------------------------------------------------------

_STRETCHES = f"""SELECT DISTINCT array_to_string(w, ' ') AS phrase, 'P' || len(w) AS tag FROM (
  SELECT forms[i:i + 1 + i % 4] AS w FROM (SELECT forms, unnest(range(1, 26, 2)) AS i FROM (
    SELECT list_filter({_SQL_FORMS}, lambda f: f <> '') AS forms FROM documents))) WHERE len(w) > 0"""


#: What stands between two words, with the words of signs alone that stand there too.
_BETWEEN = r"[ \n\t\r][ \n\t\r.,;:!?()]*[ \n\t\r]|[ \n\t\r]"


def first_forms(text, most):
    """The first forms of a text that are not empty; nothing is made of the words behind them."""
    begun = F.slice(F.split(text, _BETWEEN, most + 2), 1, most + 1)   # only the first, or the text's last, may have an empty form
    return F.slice(F.filter(F.transform(begun, match_form), lambda f: f != ""), 1, most)


@query("automaton_tagger", _sql_fold(_STRETCHES, "documents", "doc_id"))
def automaton_tagger(spark, d):
    """Some twelve phrases of three or five words from each document, looked up in all documents."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    forms = first_forms(F.col("text"), 27)
    stretches = let(forms, lambda held: F.transform(F.sequence(F.lit(1), F.lit(25), F.lit(2)), lambda i: F.slice(held, i, 2 + i % 4)))
    phrases = documents.select(F.explode(stretches).alias("w")).where(F.size("w") > 0) \
        .select(F.array_join("w", " ").alias("phrase"), F.concat(F.lit("P"), F.size("w").cast("string")).alias("tag")).distinct()
    return _span_rows(automaton.tag_documents(documents, "doc_id", "text", phrases), "doc_id")


# --- what breaks on the way ---------------------------------------------------------------------------------------

@query("feed_broken_snapshot", with_views("docket", """
SELECT court, 'entry' AS kind, count(*) AS n FROM single GROUP BY 1
UNION ALL SELECT court, 'docket_entry_num', count(*) FROM single WHERE contains(description, '(<a') AND docket_entry_num IS NULL GROUP BY 1
UNION ALL SELECT 'cut', 'entry', 1 UNION ALL SELECT 'cut', 'snapshot', 1""", single=_ONE_PER_KEY))
def feed_broken_snapshot(spark, d):
    """Snapshots of which one is cut off in its second entry: the others land whole, and the file is one row set aside."""
    path, aside = _landed_feeds(spark, d), scratch_path(spark, "quarantine")
    oldest = F.min(F.struct("pub_date", "entry_id")).alias("o")
    item = F.concat(F.lit("<channel><item><title>9:99-zz-1 cut</title><link>"), F.col("o.entry_id").cast("string"), F.lit(
        "</link><guid>g</guid><pubDate>Mon, 07 Jun 2021 19:09:30 GMT</pubDate></item><item><title>9:99-zz-2 lost</ti"))
    docket(spark, d).agg(oldest).select(item.alias("value")).write.text(f"{path}/court=cut")
    target = _warehouse(spark).table("rss_docket_entries")
    ingest.start_ingest(feeds.stream_feed_snapshots(spark, path), target, aside, scratch_path(spark, "offsets")).awaitTermination()
    landed = target.read().groupBy("court").agg(F.count(F.lit(1)).alias("n")).select("court", F.lit("entry").alias("kind"), "n")
    return landed.unionByName(spark.read.parquet(aside).groupBy("court", F.col("rule").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("search_pages_unnumbered", with_views("search_results", """
SELECT category, court_id, sum(n_lines)::bigint AS n_lines, count(*) AS n_parts FROM sections GROUP BY 1, 2""",
    scored="SELECT *, (description ILIKE '%warrant%')::int AS predicted_class FROM search_results",
    found=_SEARCH_FOUND, entities="SELECT * FROM found WHERE NOT starts_with(category, 'L-')", cases=_CASES,
    sections="""SELECT category, court_id, part_no, count(*) AS n_lines FROM (SELECT *, (row_number() OVER (PARTITION BY category,
      court_id ORDER BY doc_order) - 1) // 3 AS part_no FROM cases) GROUP BY 1, 2, 3"""))
def search_pages_unnumbered(spark, d):
    """Results in pages none of which has a number: every case is one line of its section."""
    result = F.struct("absolute_url", "caseName", "court_id", "description", F.col("date_filed").alias("dateFiled"))
    path = scratch_path(spark, "pages")
    search_results(spark, d).groupBy(F.floor(F.col("doc_order") / 400).alias("part")) \
        .agg(F.sort_array(F.collect_list(result)).alias("results")).write.partitionBy("part").json(path)
    found = search_alert.landed_results(spark, path, SEARCH_DATE, "", lookback_days=40_000, cap=None)
    alert = search_alert.run(found, found.select("absolute_url").limit(0), search_scorer, search_tagger)
    return digest.court_sections(alert.cases, lines_per_part=3).groupBy("category", "court_id") \
        .agg(F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("n_parts"))
