"""Queries: scoring, tagging, digests, messages and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.fixed_values import FEED_CLASS_TYPE, FEED_INTRO, SEARCH_CLASS_TYPE, SEARCH_ENTITY_TYPE
from docketflow.operators import digest, evaluate, scoring, select, state, tagging
from docketflow.plans import feed_alert, search_alert
from docketflow.plans.adapters import (
    SQL_WORDS, WORD_CLASS, docket, predictions, raw_tags, search_results, sentences, table, with_views,
)
from docketflow.plans.queries_feed import START, _SQL_CANDIDATE, _SQL_SEEN
from docketflow.plans.registry import query
from docketflow.functions import spans as S
from docketflow.functions.text import match_form, words
from docketflow.schemas import DOCKET_KEY

# --- scorers ------------------------------------------------------------------------------------------------------

# Multiples of 1/64: their sums are exact, whatever order an engine adds them in.
WEIGHTS = {"the": 5 / 64, "of": 3 / 64, "and": -3 / 64, "license": 1.5, "der": -6 / 64, "que": -6 / 64, "la": -3 / 64,
           "in": 1 / 64}
BIAS = -0.5

_SQL_FORMS = f"list_transform({SQL_WORDS}, lambda w: lower(translate(w, '.,;:!?()', '')))"
_SQL_TOTAL = f"{BIAS} + coalesce(list_sum(list_transform(forms, lambda w: CASE w " + " ".join(
    f"WHEN '{w}' THEN {x}" for w, x in WEIGHTS.items()) + " ELSE 0.0 END::double)), 0)"
SQL_LINEAR = f"""
SELECT doc_id, (total > 0)::int AS predicted_class, round(1 / (1 + exp(-total)), 6) AS likelihood
FROM (SELECT doc_id, {_SQL_TOTAL} AS total FROM (SELECT doc_id, {_SQL_FORMS} AS forms FROM documents))"""


def _rounded(scored):
    return scored.select("doc_id", "predicted_class", F.round("likelihood", 6).alias("likelihood"))


@query("keyword_score", """
SELECT doc_id, (text ILIKE '%license%' OR text ILIKE '%the of%')::int AS predicted_class,
  (text ILIKE '%license%' OR text ILIKE '%the of%')::int::double AS likelihood FROM documents""")
def keyword_score(spark, d):
    scored = scoring.keyword_score(table(spark, d, "documents"), "text", ["license", "the of"])
    return scored.select("doc_id", "predicted_class", "likelihood")


@query("linear_score", SQL_LINEAR)
def linear_score(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text")
    return _rounded(scoring.linear_score(documents, "text", WEIGHTS, BIAS))


@query("arrow_score", SQL_LINEAR)
def arrow_score(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text")
    return _rounded(scoring.score_with(documents, "text", scoring.linear_factory(WEIGHTS, BIAS)))


@query("encode_tokens", f"""
WITH e AS (SELECT doc_id, list_slice(list_concat([101::bigint], list_concat(list_transform({_SQL_FORMS},
  lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 29000 + 1000), [102::bigint])), 1, 64) AS ids FROM documents)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(64 - len(ids)), lambda i: 0::bigint)), ' ')
  AS ids, len(ids)::bigint AS n_attended FROM e""")
def encode_tokens(spark, d):
    """Fixed-length encoding: cutting at 64 ids is the operator itself."""
    encoded = table(spark, d, "documents").select("doc_id", scoring.encode(F.col("text")).alias("ids"))
    attended = F.aggregate(scoring.attention_mask(F.col("ids")), F.lit(0), lambda a, m: a + m)
    return encoded.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"),
                          attended.cast("bigint").alias("n_attended"))


# --- taggers ------------------------------------------------------------------------------------------------------

DOCUMENT_GAZETTEER = {"license": "DOCUMENT", "the of": "PAIR", "of the": "PAIR", "the the": "TWIN", "the": "WORD",
                      "and the of": "TRIPLE", "de la": "PAIR"}


def _sql_longest(gazetteer: dict[str, str], source: str, key: str) -> str:
    """Leftmost-longest dictionary matches as SQL: n-grams, longest per start, then one fold per text."""
    values = ", ".join(f"('{p}', '{t}')" for p, t in gazetteer.items())
    return _sql_fold(f"SELECT * FROM (VALUES {values}) v(phrase, tag)", source, key)


def _sql_fold(gazetteer_sql: str, source: str, key: str) -> str:
    return f"""
WITH gaz AS ({gazetteer_sql}),
lens AS (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM gaz),
texts AS (SELECT {key}, {SQL_WORDS} AS ws, {_SQL_FORMS} AS fs FROM {source}),
places AS (SELECT {key}, ws, fs, n, unnest(range(0, len(ws) - n + 1)) AS i FROM texts, lens),
grams AS (SELECT {key}, i, n, array_to_string(ws[i + 1:i + n], ' ') AS text, array_to_string(fs[i + 1:i + n], ' ') AS gram
  FROM places),
best AS (SELECT {key}, i, n, text, tag FROM grams JOIN gaz ON gram = phrase
  QUALIFY row_number() OVER (PARTITION BY {key}, i ORDER BY n DESC) = 1),
lists AS (SELECT {key}, list({{'s': i, 'e': i + n, 'x': text, 't': tag}} ORDER BY i) AS hs FROM best GROUP BY 1),
kept AS (SELECT {key}, unnest(list_reduce(hs, lambda acc, h: CASE WHEN acc[-1].e <= h.s THEN list_append(acc, h)
  ELSE acc END, [{{'s': -1::bigint, 'e': 0::bigint, 'x': '', 't': ''}}])) AS k FROM lists)
SELECT {key}, k.s AS start_pos, k.e AS end_pos, k.x AS text, k.t AS tag FROM kept WHERE k.s >= 0"""


def _span_rows(tagged, key):
    return tagged.select(key, F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint")
                         .alias("end_pos"), "text", "tag")


@query("dictionary_tagger", _sql_longest(DOCUMENT_GAZETTEER, "documents", "doc_id"))
def dictionary_tagger(spark, d):
    spans = table(spark, d, "documents").select(
        "doc_id", tagging.dictionary_spans(F.col("text"), DOCUMENT_GAZETTEER).alias("spans"))
    tagged = spans.select("doc_id", F.explode("spans").alias("s"))
    return _span_rows(tagged.select("doc_id", "s.*"), "doc_id")


_LEARNT = f"""SELECT phrase, arg_max(class, (n, class)) AS tag FROM (SELECT lower(text) AS phrase, class, count(*) AS n
    FROM spans GROUP BY 1, 2) GROUP BY 1"""
_OPENINGS = f"""SELECT array_to_string({_SQL_FORMS}[1:6], ' ') AS phrase, 'OPENING' AS tag FROM benchmark
  UNION SELECT array_to_string({_SQL_FORMS}[8:12], ' '), 'MIDDLE' FROM benchmark"""


@query("learnt_dictionary_tagger", _sql_fold(with_views(
    "spans", f"SELECT phrase, min(tag) AS tag FROM ({_LEARNT} UNION ALL {_OPENINGS}) WHERE phrase <> '' GROUP BY 1"),
    "benchmark", "item_id"))
def learnt_dictionary_tagger(spark, d):
    """A dictionary learnt from the tagged sentences, with phrases of five and six words, applied through joins."""
    decoded = sentences(spark, d).select(F.explode(S.decode_spans(F.col("words"), F.col("tags"))).alias("s"))
    learnt = tagging.gazetteer_from_spans(decoded.select("s.text", "s.tag"))
    benchmark = table(spark, d, "benchmark")
    forms = F.transform(words(F.col("text")), match_form)
    openings = benchmark.select(F.explode(F.array(
        F.struct(F.array_join(F.slice(forms, 1, 6), " ").alias("phrase"), F.lit("OPENING").alias("tag")),
        F.struct(F.array_join(F.slice(forms, 8, 5), " ").alias("phrase"), F.lit("MIDDLE").alias("tag")))).alias("p")).select("p.*")
    return _span_rows(tagging.dictionary_matches(benchmark, "item_id", "text", learnt.unionByName(openings)), "item_id")


@query("arrow_tagger", _sql_longest({"license": "DOCUMENT"}, "documents", "doc_id"))
def arrow_tagger(spark, d):
    """The harness for external taggers, here with a tagger of single words."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    tagged = tagging.tag_with(documents, "text", tagging.word_tagger({"license": "DOCUMENT"}))
    return _span_rows(tagged.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*"), "doc_id")


# --- feed alert ---------------------------------------------------------------------------------------------------

def feed_scorer(rows, text_column):
    return scoring.keyword_score(rows, text_column, feed_alert.KEYWORDS)


def feed_tagger(text):
    return tagging.dictionary_spans(text, feed_alert.GAZETTEER)


def _feed_alert(spark, d):
    return feed_alert.run(docket(spark, d), predictions(spark, d), START, "entry_id", feed_scorer, feed_tagger)


_FEED_VIEWS = "docket predictions"
_FEED_SCORED = f"""SELECT *, case_name || ' | ' || document_type AS to_classify,
  ((case_name || ' | ' || document_type) ILIKE '%warrant%')::int AS predicted_class FROM docket k
  WHERE {_SQL_CANDIDATE} AND pub_date > TIMESTAMP '{START}' AND case_name IS NOT NULL
  AND NOT EXISTS ({_SQL_SEEN} AND p.prediction_type = 'swornot')"""
_FEED_ENTITIES = """SELECT case_number, pub_date, entry_id AS doc_order, case_name, court AS court_id,
  split_part(guid, '&', 1) AS absolute_url, document_type, 0 AS span_pos,
  CASE WHEN contains(case_name, 'Black phone') THEN 'Black phone' WHEN contains(case_name, 'One parcel')
    THEN 'One parcel' WHEN contains(case_name, 'Silver car') THEN 'Silver car' END AS thing_searched,
  CASE WHEN contains(case_name, 'Black phone') THEN 'PHONE' WHEN contains(case_name, 'One parcel') THEN 'PACKAGE'
    WHEN contains(case_name, 'Silver car') THEN 'CAR' ELSE 'no category detected' END AS category
  FROM scored WHERE predicted_class = 1"""
_SQUASH = "replace(replace(lower({0}), ' ', ''), ',', '')"
_MENTIONED = f"contains({_SQUASH.format('case_name')}, {_SQUASH.format('thing_searched')})"
_CASES = f"""SELECT *, '- ' || case_name || '    *' || court_id || '*' || CASE WHEN thing_searched <> ''
    AND NOT {_MENTIONED} THEN chr(10) || '  ' || thing_searched ELSE '' END AS case_string
  FROM entities WHERE category <> 'no category detected'
  QUALIFY row_number() OVER (PARTITION BY category, case_string ORDER BY doc_order, span_pos) = 1"""
_FEED = {"scored": _FEED_SCORED, "entities": _FEED_ENTITIES, "cases": _CASES}

_CASE_COLUMNS = ["category", "case_string", "case_name", "thing_searched", "court_id", "absolute_url", "doc_order",
                 "span_pos"]


@query("alert_digest", with_views(_FEED_VIEWS, f"SELECT {', '.join(_CASE_COLUMNS)}, document_type FROM cases",
                                  **_FEED))
def alert_digest(spark, d):
    return _feed_alert(spark, d).cases.select(*_CASE_COLUMNS, "document_type")


@query("alert_by_court", with_views(_FEED_VIEWS, """
SELECT category, court_id, count(*) AS n_cases, min(doc_order) AS first_doc_order FROM cases GROUP BY 1, 2""", **_FEED))
def alert_by_court(spark, d):
    return _feed_alert(spark, d).cases.groupBy("category", "court_id").agg(
        F.count(F.lit(1)).alias("n_cases"), F.min("doc_order").alias("first_doc_order"))


_LINES = f"""SELECT *, '<' || absolute_url || '|' || case_name || '> ' || CASE WHEN thing_searched <> ''
    AND NOT {_MENTIONED} THEN thing_searched ELSE '' END || ' ' || type_text || chr(10) AS link_line,
  '- ' || case_name || '   ' || CASE WHEN thing_searched <> '' AND NOT {_MENTIONED}
    THEN chr(10) || '  ' || thing_searched ELSE '' END || ' ' || type_text AS text_line FROM typed"""
_FEED_TYPED = "SELECT *, CASE WHEN document_type <> '' THEN '[' || document_type || ']' ELSE '' END AS type_text FROM cases"
_FEED_LINES = {**_FEED, "typed": _FEED_TYPED, "lines": _LINES}


@query("digest_lines", with_views(_FEED_VIEWS, "SELECT category, doc_order, link_line, text_line FROM lines",
                                  **_FEED_LINES))
def digest_lines(spark, d):
    return digest.with_lines(_feed_alert(spark, d).cases).select("category", "doc_order", "link_line", "text_line")


@query("prediction_log", with_views(_FEED_VIEWS, f"""
SELECT DISTINCT md5(case_number || '|' || strftime(pub_date, '%Y-%m-%d %H:%M:%S') || '|{FEED_CLASS_TYPE}') AS log_key,
  case_number, pub_date, '{FEED_CLASS_TYPE}' AS prediction_type,
  max(predicted_class) OVER (PARTITION BY case_number, pub_date) = 1 AS prediction_value FROM scored""", **_FEED))
def prediction_log(spark, d):
    """Class log of the feed alert; entries sharing a key count as positive when one of them is."""
    log = _feed_alert(spark, d).class_log
    return log.groupBy("log_key", *DOCKET_KEY, "prediction_type").agg(
        F.bool_or("prediction_value").alias("prediction_value"))


# --- search alert -------------------------------------------------------------------------------------------------

def search_scorer(rows, text_column):
    return scoring.keyword_score(rows, text_column, feed_alert.KEYWORDS)


def search_tagger(text):
    return tagging.dictionary_spans(text, search_alert.GAZETTEER)


def _search_log(spark, d):
    """Addresses scored before: orders that hold a returned line item."""
    from docketflow.functions.parse import absolute_url
    lines = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R")
    path = F.concat(F.lit("/docket/"), F.col("l_orderkey").cast("string"), F.lit("/"))
    return lines.select(absolute_url(path).alias("absolute_url"))


def _search_alert(spark, d):
    return search_alert.run(search_results(spark, d), _search_log(spark, d), search_scorer, search_tagger)


_SEARCH_SCORED = """SELECT * EXCLUDE (absolute_url), 'https://www.courtlistener.com' || absolute_url AS absolute_url,
  (description ILIKE '%warrant%')::int AS predicted_class FROM search_results
  WHERE doc_order NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""


def _sql_item(results: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(description, '\\b{p}$') THEN '{r}'" for p, r in results.items()) \
        + " END"


_BY_LENGTH = dict(sorted(search_alert.GAZETTEER.items(), key=lambda kv: -len(kv[0])))
_SEARCH_FOUND = f"""SELECT doc_order, caseName AS case_name, court_id, absolute_url, description,
  {_sql_item({p: p for p in _BY_LENGTH})} AS thing_searched,
  coalesce({_sql_item(_BY_LENGTH)}, 'no category detected') AS category, 0 AS span_pos
  FROM scored WHERE predicted_class = 1"""
_SEARCH = {"scored": _SEARCH_SCORED, "found": _SEARCH_FOUND,
           "entities": "SELECT * FROM found WHERE NOT starts_with(category, 'L-')", "cases": _CASES}
_SEARCH_LINES = {**_SEARCH, "typed": "SELECT *, '' AS type_text FROM cases", "lines": _LINES}


@query("search_digest", with_views("search_results", f"SELECT {', '.join(_CASE_COLUMNS)}, description FROM cases",
                                   **_SEARCH))
def search_digest(spark, d):
    return _search_alert(spark, d).cases.select(*_CASE_COLUMNS, "description")


@query("entity_log", with_views("search_results", f"""
SELECT md5(absolute_url || '|' || '0' || '|{SEARCH_ENTITY_TYPE}') AS log_key, absolute_url,
  '{SEARCH_ENTITY_TYPE}' AS prediction_type, category AS prediction_value, thing_searched AS prediction_substring
FROM entities""", **_SEARCH))
def entity_log(spark, d):
    return _search_alert(spark, d).entity_log


@query("search_prediction_log", with_views("search_results", f"""
SELECT md5(absolute_url || '|{SEARCH_CLASS_TYPE}') AS log_key, absolute_url, '{SEARCH_CLASS_TYPE}' AS prediction_type,
  predicted_class = 1 AS prediction_value, predicted_class::double AS likelihood FROM scored""", **_SEARCH))
def search_prediction_log(spark, d):
    return _search_alert(spark, d).class_log


_NULL_VIEWS = {
    "gaps": """SELECT * REPLACE (CASE WHEN suit_nature <> 'BUILDING' THEN caseName || ' &eacute; &#38; &ndash;' END AS caseName,
      CASE WHEN is_available THEN court_id END AS court_id) FROM search_results""",
    "scored": """SELECT * EXCLUDE (absolute_url), 'https://www.courtlistener.com' || absolute_url AS absolute_url,
      (description ILIKE '%warrant%')::int AS predicted_class FROM gaps""",
    "found": _SEARCH_FOUND, "entities": "SELECT * FROM found WHERE NOT starts_with(category, 'L-')",
}


def _gap_alert(spark, d):
    """Search alert over results of which some lack a name and some a court, and names hold references."""
    name = F.concat("caseName", F.lit(" &eacute; &#38; &ndash;"))
    gaps = search_results(spark, d).withColumns({
        "caseName": F.when(F.col("suit_nature") != "BUILDING", name), "court_id": F.when(F.col("is_available"), F.col("court_id"))})
    return search_alert.run(gaps, gaps.select("absolute_url").limit(0), search_scorer, search_tagger)


@query("digest_null_names", with_views("search_results", """
SELECT category, '- ' || coalesce(case_name, absolute_url) || '    *' || coalesce(court_id, '') || '*' || CASE WHEN
    thing_searched <> '' AND NOT coalesce(contains(replace(replace(lower(case_name), ' ', ''), ',', ''),
    replace(replace(lower(thing_searched), ' ', ''), ',', '')), false) THEN chr(10) || '  ' || thing_searched ELSE '' END
  AS case_string, count(*) AS n_entities, min(doc_order) AS doc_order
FROM entities WHERE category <> 'no category detected' GROUP BY 1, 2""", **_NULL_VIEWS))
def digest_null_names(spark, d):
    """Every entity belongs to a case, whatever its case lacks."""
    alert = _gap_alert(spark, d)
    named = alert.entities.where(F.col("category") != "no category detected").groupBy("category", digest.case_string(
        F.col("case_name"), F.col("court_id"), F.col("thing_searched"), F.col("absolute_url")).alias("case_string")) \
        .agg(F.count(F.lit(1)).alias("n_entities"))
    return alert.cases.select("category", "case_string", "doc_order").join(named, ["category", "case_string"])


@query("digest_unescaped", with_views("search_results", """
SELECT category, doc_order, '<' || absolute_url || '|' || coalesce(replace(case_name, '&eacute; &#38; &ndash;', 'é & –'),
    absolute_url) || '> ' || CASE WHEN thing_searched <> '' AND NOT coalesce(contains(replace(replace(lower(case_name), ' ', ''),
    ',', ''), replace(replace(lower(thing_searched), ' ', ''), ',', '')), false) THEN thing_searched ELSE '' END || ' ' || chr(10)
  AS link_line FROM entities WHERE category <> 'no category detected'
  QUALIFY row_number() OVER (PARTITION BY category, coalesce(case_name, absolute_url), coalesce(court_id, ''),
    thing_searched ORDER BY doc_order, span_pos) = 1""", **_NULL_VIEWS))
def digest_unescaped(spark, d):
    """Digest lines with all references resolved."""
    return digest.with_lines(_gap_alert(spark, d).cases).select("category", "doc_order", "link_line")


@query("category_counts", with_views("search_results", """
SELECT category, count(*) AS n_cases, min(doc_order) AS first_doc_order,
  arg_min(span_pos, (doc_order, span_pos))::int AS first_span_pos,
  row_number() OVER (ORDER BY min((doc_order, span_pos))) AS place FROM cases GROUP BY 1""", **_SEARCH))
def category_counts(spark, d):
    """Cases per category, in order of first appearance."""
    return digest.ordered_categories(_search_alert(spark, d).cases)


@query("sorted_by_court", with_views("search_results", """
SELECT category, court_id, doc_order, case_string,
  row_number() OVER (PARTITION BY category, court_id ORDER BY doc_order, span_pos) AS line_no FROM cases""", **_SEARCH))
def sorted_by_court(spark, d):
    return digest.court_order(_search_alert(spark, d).cases) \
        .select("category", "court_id", "doc_order", "case_string", "line_no")


PART = 3
def _sql_sections(part: int) -> str:
    return f"""SELECT category, court_id, part_no, count(*) AS n_lines,
  string_agg('• ' || link_line, chr(10) ORDER BY line_no) AS body
  FROM (SELECT *, (line_no - 1) // {part} AS part_no FROM (SELECT *, row_number() OVER (PARTITION BY category, court_id
    ORDER BY doc_order, span_pos) AS line_no FROM lines)) GROUP BY 1, 2, 3"""


@query("court_sections", with_views("search_results", "SELECT * FROM sections", **_SEARCH_LINES, sections=_sql_sections(PART)))
def court_sections(spark, d):
    return digest.court_sections(_search_alert(spark, d).cases, lines_per_part=PART)


def _sql_blocks(intro: str, part: int) -> dict[str, str]:
    first = "SELECT category, min((doc_order, span_pos)) AS f FROM cases GROUP BY 1"
    raw = f"""SELECT f, 2 AS rank, category, court_id, part_no, 'section' AS kind, 
      '*' || court_id || CASE WHEN part_no > 0 THEN ' (' || (part_no + 1) || ')' ELSE '' END || ':*' || chr(10) || chr(10)
      || body AS text FROM sections JOIN firsts USING (category)
    UNION ALL SELECT f, 0, category, '', 0, 'divider', NULL FROM firsts
    UNION ALL SELECT f, 1, category, '', 0, 'section', '*' || category || ':*' FROM firsts
    UNION ALL SELECT min(f), -1, '', '', 0, 'section', '*{intro}:*' FROM firsts HAVING count(*) > 0"""
    return {"sections": _sql_sections(part), "firsts": first, "raw_blocks": raw, "numbered": """SELECT *,
      row_number() OVER (ORDER BY f, rank, court_id, part_no) AS block_no FROM raw_blocks""",
            "blocks": """SELECT block_no, (block_no - 1) // 46 AS message_no, kind, category, court_id, part_no, text
      FROM numbered"""}


_BLOCK_VIEWS = {**_SEARCH_LINES, **_sql_blocks("found by search", PART)}


@query("message_chunks", with_views("search_results", "SELECT * FROM blocks", **_BLOCK_VIEWS))
def message_chunks(spark, d):
    return digest.message_blocks(_search_alert(spark, d).cases, "found by search", PART)


@query("message_outbox", with_views("search_results", """
SELECT message_no, count(*) AS n_blocks, '{"blocks":[' || string_agg('{"type":"' || kind || '"' ||
  CASE WHEN text IS NULL THEN '' ELSE ',"text":{"type":"mrkdwn","text":' || to_json(text) || '}' END || '}', ','
  ORDER BY block_no) || ']}' AS payload FROM blocks GROUP BY 1""", **_BLOCK_VIEWS))
def message_outbox(spark, d):
    return digest.outbox(digest.message_blocks(_search_alert(spark, d).cases, "found by search", PART))


_FEED_BLOCKS = {**_FEED_LINES, **_sql_blocks(FEED_INTRO, digest.LINES_PER_PART)}


@query("feed_message_chunks", with_views(_FEED_VIEWS, "SELECT * FROM blocks", **_FEED_BLOCKS))
def feed_message_chunks(spark, d):
    """With the default size of a part."""
    return digest.message_blocks(_feed_alert(spark, d).cases, FEED_INTRO)


@query("digest_json", with_views("search_results", """
SELECT category, part_no, count(*) AS n_cases, '{' || string_agg(to_json(case_string) || ':' || json_object(
  'absolute_url', absolute_url, 'case_name', case_name, 'category', category, 'court_id', court_id,
  'description', description, 'thing_searched', thing_searched), ',' ORDER BY case_string) || '}' AS body
FROM (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY case_string) - 1) // 50 AS part_no FROM cases)
GROUP BY 1, 2""", **_SEARCH))
def digest_json(spark, d):
    return digest.json_report(_search_alert(spark, d).cases, 50)


# --- evaluation ---------------------------------------------------------------------------------------------------

_LABELLED = f"SELECT doc_id, predicted_class, likelihood, quality AS label FROM ({SQL_LINEAR}) JOIN labels USING (doc_id)"


def _labelled(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return scoring.linear_score(documents.join(labels, "doc_id"), "text", WEIGHTS, BIAS).drop("text")


def _sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN round(({a}) / ({b})::double, 6) ELSE 0.0 END"


@query("eval_classifier", f"""
WITH s AS ({_LABELLED}), c AS (SELECT count(*) AS n, count(*) FILTER (label = 1 AND predicted_class = 1) AS tp,
  count(*) FILTER (label <> 1 AND predicted_class = 1) AS fp, count(*) FILTER (label = 1 AND predicted_class <> 1) AS fn,
  count(*) FILTER (label <> 1 AND predicted_class <> 1) AS tn FROM s)
SELECT n, tp, fp, fn, tn, {_sql_ratio('tp + tn', 'n')} AS accuracy, {_sql_ratio('tp', '(tp + fp)')} AS precision,
  {_sql_ratio('tp', '(tp + fn)')} AS recall, {_sql_ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM c""")
def eval_classifier(spark, d):
    return evaluate.classifier_metrics(_labelled(spark, d))


@query("confusion_matrix", f"WITH s AS ({_LABELLED}) SELECT label, predicted_class, count(*) AS n FROM s GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return evaluate.confusion(_labelled(spark, d))


@query("false_positive_review", f"""
WITH s AS ({_LABELLED}) SELECT doc_id, likelihood FROM s WHERE predicted_class = 1 AND label = 0""")
def false_positive_review(spark, d):
    return evaluate.wrong_positives(_labelled(spark, d)).select("doc_id", F.round("likelihood", 6).alias("likelihood"))


# The second tagger of the comparison: it misses one word and confuses another.
OTHER_WORD_CLASS = {**{w: c for w, c in WORD_CLASS.items() if w != "and"}, "la": "car"}


def _sql_span_counts() -> str:
    whens = " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in OTHER_WORD_CLASS.items())
    return with_views("spans", "SELECT * FROM counts",
                      other=f"SELECT sent_id, pos, CASE token {whens} END AS class FROM tokens",
                      marks="""SELECT *, class IS DISTINCT FROM lag(class) OVER (PARTITION BY sent_id ORDER BY pos)
                        AS opens FROM other""",
                      islands="""SELECT *, sum(opens::int) OVER (PARTITION BY sent_id ORDER BY pos) AS island
                        FROM marks""",
                      predicted="""SELECT sent_id, class, min(pos) AS start_pos, max(pos) + 1 AS end_pos FROM islands
                        WHERE class IS NOT NULL GROUP BY sent_id, class, island""",
                      counts="""SELECT coalesce(g.class, p.class) AS tag,
                        count(*) FILTER (g.class IS NOT NULL AND p.class IS NOT NULL) AS tp,
                        count(*) FILTER (g.class IS NULL) AS fp, count(*) FILTER (p.class IS NULL) AS fn
                        FROM spans g FULL JOIN predicted p ON g.sent_id = p.sent_id AND g.class = p.class
                          AND g.start_pos = p.start_pos AND g.end_pos = p.end_pos GROUP BY 1""")


def _span_counts(spark, d):
    def side(tags, is_gold):
        return F.transform(S.decode_spans(F.col("words"), tags), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["tag"].alias("tag"), F.lit(is_gold).alias("is_gold")))
    both = F.concat(side(F.col("tags"), True), side(raw_tags(F.col("words"), OTHER_WORD_CLASS), False))
    return evaluate.side_counts(sentences(spark, d).select("sent_id", F.explode(both).alias("s")).select("sent_id", "s.*"))


_F1 = _sql_ratio("2 * tp", "(2 * tp + fp + fn)")


@query("eval_spans", f"SELECT tag, tp, fp, fn, {_F1} AS f1 FROM ({_sql_span_counts()})")
def eval_spans(spark, d):
    return evaluate.span_f1_by_class(_span_counts(spark, d))


@query("eval_spans_summary", f"""
SELECT sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn,
  round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS f1_macro,
  round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro FROM ({_sql_span_counts()})""")
def eval_spans_summary(spark, d):
    return evaluate.span_f1(_span_counts(spark, d))
