"""Queries: parsing, selection, keyed state and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docketflow.fixed_values import ARCHIVE_HOST, BANKRUPTCY_COURTS, BARE_CASE_NAME, BARE_CASE_SENTENCE, DISTRICT_COURTS
from docketflow.functions import parse
from docketflow.functions.text import html_unescape, unescape_known
from docketflow.operators import audit, select, state, tagging
from docketflow.plans.adapters import docket, docket_raw, predictions, search_results, table, with_views
from docketflow.plans.feed_alert import GAZETTEER
from docketflow.plans.registry import query
from docketflow.schemas import DOCKET, DOCKET_KEY
from docketflow.sources.artifacts import missing_artifacts
from docketflow.sources.feeds import courts, feed_quarantine
from docketflow.sources.search_results import kept_pages, matches_terms, search, search_by_keywords

START = dt.date(1996, 6, 1)
RUN_DATE = dt.date(2001, 7, 31)
DOCKET_COLUMNS = ", ".join(DOCKET.names)


@query("feed_normalise", with_views("docket", f"SELECT entry_id, {DOCKET_COLUMNS} FROM docket"))
def feed_normalise(spark, d):
    return docket(spark, d).drop("nation_key")


@query("feed_quarantine", with_views("docket_raw docket", """
SELECT guid, court, 'docket_entry_num' AS rule, regexp_extract(description, '>([^<]*)</a>', 1) AS text FROM docket
WHERE contains(description, '(<a') AND docket_entry_num IS NULL"""))
def quarantine(spark, d):
    return feed_quarantine(docket_raw(spark, d), unescape_known)


@query("html_title_unescape", r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(html, '<title>([^<]*)</title>', 1), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'),
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS title FROM pages)
SELECT page_id, title, split_part(title, ' ', 1) AS first_word,
  CASE WHEN strpos(title, ' ') > 0 THEN substr(title, strpos(title, ' ') + 1) END AS remainder FROM t""")
def html_title_unescape(spark, d):
    pages = table(spark, d, "pages")
    titled = pages.select("page_id", html_unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
                          .alias("title"))
    return titled.select("page_id", "title", parse.case_number(F.col("title")).alias("first_word"),
                         parse.case_name(F.col("title")).alias("remainder"))


@query("page_links", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages)
SELECT page_id, (unnest(range(len(hrefs))))::bigint AS link_no, unnest(hrefs) AS href, unnest(texts) AS anchor_text
FROM a""")
def page_links(spark, d):
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    links = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"),
                         F.regexp_extract_all("html", pattern, F.lit(2)).alias("anchor_text"))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(links).alias("link_no", "l"))
    return rows.select("page_id", F.col("link_no").cast("bigint").alias("link_no"), "l.href", "l.anchor_text")


def _sql_param(name: str) -> str:
    return rf"""nullif(url_decode(regexp_extract(regexp_extract(url, '^[^?#]*\?([^#]*)', 1),
        '(?:^|&){name}=([^&]+)', 1)), '')"""


@query("url_params", f"""
SELECT page_id, try_cast({_sql_param('page')} AS int) AS page_no, {_sql_param('ref')} AS ref,
  {_sql_param('utm_source')} AS utm_source FROM pages""")
def url_params(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", parse.query_parameter(url, "page").try_cast("int").alias("page_no"),
        parse.query_parameter(url, "ref").alias("ref"),
        parse.query_parameter(url, "utm_source").alias("utm_source"))


@query("url_segments", """
WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages)
SELECT page_id, parts[-1] AS last_segment, parts[-2] AS parent_segment,
  'pdfs/' || parts[-1] || '/' || parts[-2] || '.pdf' AS pdf FROM p WHERE len(parts) >= 2""")
def url_segments(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", parse.url_segment(url, -1).alias("last_segment"), parse.url_segment(url, -2).alias("parent_segment"),
        parse.pdf_path(url, url).alias("pdf")).where(F.col("parent_segment").isNotNull())


@query("archive_path_url", f"""
WITH p AS (SELECT page_id, '/storage/sata' || regexp_replace(url, '^https?:/', '') AS path FROM pages)
SELECT page_id, replace(replace(path, '/storage', '{ARCHIVE_HOST}'), '/sata', '{ARCHIVE_HOST}') AS url,
  'search_warrant/' || string_split(path, '/')[-1] AS local_path FROM p""")
def archive_path_url(spark, d):
    path = F.concat(F.lit("/storage/sata"), F.regexp_replace("url", "^https?:/", ""))
    return table(spark, d, "pages").select(
        "page_id", parse.archive_url(path).alias("url"), parse.archive_path(path, "search_warrant").alias("local_path"))


_FACETS = r"'^(\d+):(\d{2})-([a-z]+)-(\d+)(?:-(\d+))?$'"


@query("case_number_facets", with_views("docket", "SELECT entry_id, " + ", ".join(
    f"nullif(regexp_extract(case_number, {_FACETS}, {k + 1}), '') AS {name}"
    for k, name in enumerate(["office", "filed_year", "case_type", "serial", "defendant"])) + " FROM docket"))
def case_number_facets(spark, d):
    return docket(spark, d).select("entry_id", *parse.case_number_facets(F.col("case_number")))


@query("case_type_counts", with_views("docket", f"""
SELECT nullif(regexp_extract(case_number, {_FACETS}, 3), '') AS case_type, count(*) AS n_entries,
  count(*) FILTER (document_type ILIKE '%warrant%') AS n_warrants FROM docket GROUP BY 1"""))
def case_type_counts(spark, d):
    kind = parse.case_number_facets(F.col("case_number"))[2]
    return docket(spark, d).select(kind, "document_type").groupBy("case_type").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(F.col("document_type").ilike("%warrant%")).alias("n_warrants"))


@query("court_coverage", with_views("docket", """
SELECT c.court, c.court_type, n_name, r_name, coalesce(n, 0) AS n_entries
FROM listed c LEFT JOIN nation ON n_nationkey = c.nation_key LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT nation_key, count(*) AS n FROM docket GROUP BY 1) k ON k.nation_key = c.nation_key""",
    listed="SELECT unnest(['" + "', '".join(DISTRICT_COURTS + BANKRUPTCY_COURTS) + "']) AS court, unnest("
    f"list_concat(list_transform(range({len(DISTRICT_COURTS)}), lambda i: 'district'), "
    f"list_transform(range({len(BANKRUPTCY_COURTS)}), lambda i: 'bankruptcy'))) AS court_type, "
    f"unnest(range({len(DISTRICT_COURTS) + len(BANKRUPTCY_COURTS)})) AS nation_key"))
def court_coverage(spark, d):
    """Every listed court with its place and docket entries; nation n stands for the n-th listed court."""
    place = F.array_position(F.array(*map(F.lit, DISTRICT_COURTS + BANKRUPTCY_COURTS)), F.col("court")) - 1
    listed = courts(spark).select("court", "court_type", place.alias("nation_key"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = docket(spark, d).groupBy(F.col("nation_key").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(nations, F.col("n_nationkey") == F.col("nation_key"), "left") \
        .join(counts, F.col("k") == F.col("nation_key"), "left") \
        .select("court", "court_type", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_entries"))


_SQL_CANDIDATE = "(document_type ILIKE '%warrant%' OR document_type ILIKE '%unseal%')"
_SQL_SEEN = """SELECT 1 FROM predictions p WHERE p.case_number = k.case_number AND p.pub_date = k.pub_date"""


@query("candidates", with_views("docket predictions", f"""
SELECT entry_id, case_number, pub_date, document_type FROM docket k
WHERE {_SQL_CANDIDATE} AND pub_date > TIMESTAMP '{START}'
  AND NOT EXISTS ({_SQL_SEEN} AND p.prediction_type = 'swornot')"""))
def candidates(spark, d):
    return select.candidates(docket(spark, d), predictions(spark, d), START) \
        .select("entry_id", *DOCKET_KEY, "document_type")


@query("lookback", with_views("docket predictions", f"""
SELECT entry_id, case_number, pub_date FROM docket k
WHERE {_SQL_CANDIDATE} AND pub_date > TIMESTAMP '{RUN_DATE}' - INTERVAL 800 DAY AND NOT EXISTS ({_SQL_SEEN})"""))
def lookback(spark, d):
    start = select.lookback_start(RUN_DATE, 800)
    return select.candidates(docket(spark, d), predictions(spark, d), start, None).select("entry_id", *DOCKET_KEY)


@query("unseen_urls", f"""
SELECT doc_id, '{ARCHIVE_HOST}/doc/' || doc_id || '/' AS absolute_url FROM documents
WHERE '{ARCHIVE_HOST}/doc/' || doc_id || '/' NOT IN (SELECT '{ARCHIVE_HOST}/doc/' || doc_id || '/' FROM labels)""")
def unseen_urls(spark, d):
    path = F.concat(F.lit("/doc/"), F.col("doc_id").cast("string"), F.lit("/"))
    found = table(spark, d, "documents").select("doc_id", path.alias("absolute_url"))
    log = table(spark, d, "labels").select(parse.absolute_url(path).alias("absolute_url"))
    return select.unseen_documents(found, log)


@query("entry_addresses", with_views("docket", """
SELECT split_part(guid, '&', 1) AS absolute_url, count(*) AS n_entries FROM docket GROUP BY 1"""))
def entry_addresses(spark, d):
    return docket(spark, d).groupBy(parse.entry_address(F.col("guid")).alias("absolute_url")) \
        .agg(F.count(F.lit(1)).alias("n_entries"))


@query("classify_text", with_views("docket", """
SELECT entry_id, case_name || ' | ' || document_type AS to_classify FROM docket
WHERE case_name IS NOT NULL AND document_type IS NOT NULL"""))
def classify_text(spark, d):
    return select.classification_text(docket(spark, d)).select("entry_id", "to_classify")


@query("bare_case_names", with_views("docket", f"""
SELECT entry_id AS doc_order, name AS case_name, CASE WHEN name = '{BARE_CASE_NAME}' THEN '{BARE_CASE_SENTENCE}' ELSE name END
  AS description, court AS court_id FROM (SELECT *, replace(case_name, ' Black phone', '') AS name FROM docket)"""))
def bare_case_names(spark, d):
    """Names without a thing are tagged through a whole sentence."""
    entries = docket(spark, d).withColumn("case_name", F.replace("case_name", F.lit(" Black phone"), F.lit("")))
    return select.to_alert_shape(entries, "entry_id").select("doc_order", "case_name", "description", "court_id")


@query("funnel_counts", with_views("docket", f"""
SELECT count(*) AS n_rows, count(*) FILTER ({_SQL_CANDIDATE}) AS n_candidates,
  count(*) FILTER ({_SQL_CANDIDATE} AND case_name IS NOT NULL) AS n_scored,
  count(*) FILTER (document_type ILIKE '%warrant%' AND case_name IS NOT NULL) AS n_positive,
  count(*) FILTER (length(description) = 0) AS n_blank FROM docket"""))
def funnel_counts(spark, d):
    wanted, named = select.is_candidate(F.col("document_type")), F.col("case_name").isNotNull()
    return select.funnel(
        docket(spark, d), n_candidates=wanted, n_scored=wanted & named,
        n_positive=F.col("document_type").ilike("%warrant%") & named, n_blank=F.length("description") == 0)


@query("upsert_latest", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, ts, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(spark, d):
    events = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id",
                                              "ts", "event_type", "value")
    return state.latest_per_key(events, ["user_id", "day"], "ts", "event_id")


@query("purge_keep", with_views("docket predictions",
                                f"SELECT entry_id, case_number, pub_date FROM docket k WHERE EXISTS ({_SQL_SEEN})"))
def purge_keep(spark, d):
    return state.purge_keep(docket(spark, d), predictions(spark, d)).select("entry_id", *DOCKET_KEY)


@query("purge_removed", with_views("docket predictions", """
SELECT case_number, pub_date FROM docket EXCEPT SELECT case_number, pub_date FROM predictions"""))
def purge_removed(spark, d):
    return state.purge_removed(docket(spark, d), predictions(spark, d)).select(*DOCKET_KEY).distinct()


@query("retention", with_views("docket predictions", f"""
SELECT entry_id, case_number, pub_date FROM docket k
WHERE EXISTS ({_SQL_SEEN}) OR scrape_date > TIMESTAMP '2001-01-01'"""))
def retention(spark, d):
    """A purge that leaves alone what was scraped after the run it belongs to."""
    until = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    return state.purge_keep(docket(spark, d), predictions(spark, d), until).select("entry_id", *DOCKET_KEY)


@query("key_audit", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def key_audit(spark, d):
    return audit.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("docket_key_audit", with_views("docket", """
SELECT case_number, pub_date, count(*) AS n_rows FROM docket GROUP BY 1, 2 HAVING count(*) > 1"""))
def docket_key_audit(spark, d):
    return audit.duplicate_keys(docket(spark, d), DOCKET_KEY)


@query("orphan_audit", """
SELECT 'lineitem without order' AS relation, l_orderkey AS key, count(*) AS n_rows FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
UNION ALL SELECT 'order without lineitem', o_orderkey, count(*) FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 2
UNION ALL SELECT 'document without label', doc_id, count(*) FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2""")
def orphan_audit(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    documents, labels = table(spark, d, "documents"), table(spark, d, "labels")

    def orphans(relation, child, child_key, parent, parent_key):
        keyed = child.select(F.col(child_key).alias("key"))
        found = audit.orphan_keys(keyed, parent, {"key": parent_key})
        return found.select(F.lit(relation).alias("relation"), "key", "n_rows")

    return orphans("lineitem without order", lines, "l_orderkey", orders, "o_orderkey") \
        .unionByName(orphans("order without lineitem", orders, "o_orderkey", lines, "l_orderkey")) \
        .unionByName(orphans("document without label", documents, "doc_id", labels, "doc_id"))


_SQL_THING = """CASE WHEN contains(case_name, 'Black phone') THEN 'PHONE' WHEN contains(case_name, 'One parcel')
  THEN 'PACKAGE' WHEN contains(case_name, 'Silver car') THEN 'CAR' ELSE 'no category detected' END"""


@query("parent_children", with_views("docket predictions", f"""
SELECT entry_id, k.case_number, k.pub_date, coalesce(n_classes, 0) AS n_classes, coalesce(n_positive, 0) AS n_positive,
  coalesce(n_entities, 0) AS n_entities, first_category
FROM docket k LEFT JOIN (SELECT case_number, pub_date, count(*) AS n_classes,
    count(*) FILTER (prediction_value) AS n_positive FROM predictions GROUP BY 1, 2) c USING (case_number, pub_date)
  LEFT JOIN (SELECT case_number, pub_date, count(*) FILTER ({_SQL_THING} <> 'no category detected') AS n_entities,
    min({_SQL_THING}) AS first_category FROM docket WHERE case_name IS NOT NULL GROUP BY 1, 2) e
  USING (case_number, pub_date)"""))
def parent_children(spark, d):
    entries = docket(spark, d)
    shaped = select.to_alert_shape(entries.where(F.col("case_name").isNotNull()), "entry_id", *DOCKET_KEY)
    tagged = tagging.entity_rows(shaped.withColumn("spans", tagging.dictionary_spans(F.col("description"), GAZETTEER)))
    entity_log = state.entity_log_rows(tagged, DOCKET_KEY, "swobjectner")
    return state.entries_with_counts(entries, predictions(spark, d), entity_log).select(
        "entry_id", *DOCKET_KEY, "n_classes", "n_positive", "n_entities", "first_category")


@query("entry_children", with_views("docket predictions", """
SELECT entry_id, k.case_number, k.pub_date, prediction_type, prediction_value
FROM docket k LEFT JOIN predictions p USING (case_number, pub_date)"""))
def entry_children(spark, d):
    return state.entry_children(docket(spark, d).select("entry_id", *DOCKET_KEY), predictions(spark, d))


def _searchable(spark, d):
    return search_results(spark, d).withColumnRenamed("caseName", "case_name")


_SQL_FILTERED = """SELECT doc_order, caseName AS case_name, date_filed, description FROM search_results
WHERE is_available AND date_filed >= TIMESTAMP '1998-01-01' AND suit_nature = 'BUILDING'
  AND contains(lower(description), 'search warrant')"""


def _filtered(spark, d, n=None):
    since = dt.datetime(1998, 1, 1)
    return search(_searchable(spark, d), description="search warrant", filed_after=since, available_only=True,
                  suit_nature="BUILDING", n=n).select("doc_order", "case_name", "date_filed", "description")


@query("search_filtered", with_views("search_results", _SQL_FILTERED))
def search_filtered(spark, d):
    return _filtered(spark, d)


@query("search_top_n", with_views("search_results", _SQL_FILTERED + " ORDER BY date_filed DESC, doc_order LIMIT 20"))
def search_top_n(spark, d):
    """The newest 20 of them: the limit is the operator."""
    return _filtered(spark, d, 20)


@query("search_union", with_views("search_results", r"""
SELECT doc_order, 'search warrant' AS matched_query FROM search_results
WHERE regexp_matches(description, '(?i)\bsearch\b') AND regexp_matches(description, '(?i)\bwarrant\b')
UNION ALL SELECT doc_order, 'seizure warrant' FROM search_results
WHERE regexp_matches(description, '(?i)\bseizure\b') AND regexp_matches(description, '(?i)\bwarrant\b')"""))
def search_union(spark, d):
    return search_by_keywords(_searchable(spark, d)).select("doc_order", "matched_query")


@query("search_documents", r"""
SELECT doc_id, source FROM documents
WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])license([^A-Za-z0-9_]|$)')
  AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')""")
def search_documents(spark, d):
    return table(spark, d, "documents").where(matches_terms(F.col("text"), "license the")).select("doc_id", "source")


@query("page_cap", """
WITH p AS (SELECT doc_id // 20 AS page_no, count(*) AS n_records FROM documents GROUP BY 1),
  r AS (SELECT *, sum(n_records) OVER (ORDER BY page_no)::bigint AS records_so_far FROM p)
SELECT page_no, n_records, records_so_far, records_so_far - n_records AS records_before FROM r
WHERE records_so_far - n_records <= 500""")
def page_cap(spark, d):
    pages = table(spark, d, "documents").groupBy(F.expr("doc_id div 20").alias("page_no")) \
        .agg(F.count(F.lit(1)).alias("n_records"))
    return kept_pages(pages, 500)


@query("missing_artifacts", """
SELECT 'pdfs/' || source || '/' || doc_id || '.pdf' AS artifact FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing(spark, d):
    """Attachment paths of all documents minus those of the documents that were labelled already."""
    documents = table(spark, d, "documents").select("doc_id", "source")
    path = F.concat(F.lit("pdfs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    labelled = documents.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return missing_artifacts(documents.select(path.alias("artifact")), labelled.select(path.alias("artifact")))


@query("feed_time_parse", """
SELECT o_orderkey, o_orderdate + INTERVAL (o_orderkey % 86400) SECOND AS pub_date FROM orders""")
def feed_time_parse(spark, d):
    """Order times written as feed dates in several zones and parsed back."""
    key = F.col("o_orderkey")
    zones = {0: (" GMT", 0), 1: (" EST", -5), 2: (" +0200", 2), 3: (" -0730", -7.5), 4: ("", 0)}
    zone, hours = F.lit(" PDT"), F.lit(-7.0)
    for k, (name, offset) in zones.items():
        zone = F.when(key % 6 == k, name).otherwise(zone)
        hours = F.when(key % 6 == k, float(offset)).otherwise(hours)
    shift = (key % 86400 + hours * 3600).cast("decimal(18,6)")
    local = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), shift)
    text = F.concat(F.date_format(local, "E, dd MMM yyyy HH:mm:ss"), zone)
    return table(spark, d, "orders").select("o_orderkey", parse.feed_time(text).alias("pub_date"))
