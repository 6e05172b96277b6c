"""Docket-shaped views over the given tables, for Spark and as SQL for the checks.

Each Spark view has a SQL twin of the same name in ``SQL_VIEWS``; ``with_views``
puts the ones a query needs, in order, in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.functions import spans as S
from docketflow.functions.text import let, unescape_known, words
from docketflow.sources.feeds import normalise_entries


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- docket entries from orders and customers ---------------------------------------------------------------------

def _number(key: Column) -> Column:
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.lit(5), F.length(text)), "0")


def _case_number() -> Column:
    kind = F.when(F.col("o_orderstatus") == "O", "sw").when(F.col("o_orderstatus") == "F", "sc").otherwise("cr")
    year = F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0")
    return F.concat(F.lit("1:"), year, F.lit("-"), kind, F.lit("-"), _number(F.col("o_custkey")))


def docket_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Feed-shaped entries, one per order."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    item = F.when(key % 4 == 0, "Black phone").when(key % 4 == 1, "One parcel &amp; contents") \
        .when(key % 4 == 2, "Silver car").otherwise(F.col("c_name"))
    court = F.concat(F.lit("c"), F.col("c_nationkey").cast("string"))
    kind = F.substring("o_orderpriority", 1, 1)
    doc_type = F.when(kind == "1", "Application for Search/Seizure Warrant") \
        .when(kind == "2", "Order on Motion to Unseal Case").when(kind == "3", "Notice (Other)") \
        .when(kind == "4", "Case Assigned/Reassigned").otherwise("Order")
    seq = F.when(key % 7 != 0, F.concat(F.lit("&de_seq_num="), (key % 997).cast("string"))).otherwise("")
    shown = F.when(key % 11 == 0, "n/a").otherwise((key % 89).cast("string"))
    anchor = F.concat(F.lit('(<a href="https://ecf.'), court, F.lit(".example.gov/doc1/"), key.cast("string"),
                      F.lit("?caseid="), cust, seq, F.lit('" >'), shown, F.lit("</a>)"))
    address = F.concat(F.lit("https://ecf."), court, F.lit(".example.gov/cgi-bin/DktRpt.pl?"), cust)
    named = F.when(key % 50 == 0, "").otherwise(F.concat(F.lit(" USA v. "), item))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("entry_id"), court.alias("court"), F.col("c_nationkey").alias("nation_key"),
        F.col("o_orderdate").alias("pub_date"), F.concat(_case_number(), named).alias("title"),
        F.concat(F.lit("["), doc_type, F.lit("] "), F.when(kind == "5", "").otherwise(anchor)).alias("description"),
        address.alias("link"), F.concat(address, F.lit("&e="), key.cast("string")).alias("guid"),
        (F.col("o_orderdate") + F.expr("interval 1 day")).alias("scrape_date"))


def docket(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_entries(docket_raw(spark, folder), unescape_known, keep=("entry_id", "nation_key"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Class log: one row per line item, keyed as the docket entry of its order."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", _case_number().alias("case_number"), F.col("o_orderdate").alias("pub_date"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    kind = F.when(F.col("l_returnflag") == "R", "swornot").otherwise("other")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "case_number", "pub_date", kind.alias("prediction_type"),
        (F.col("l_linestatus") == "O").alias("prediction_value"))


_SQL_CASE_NUMBER = """'1:' || lpad((year(o_orderdate) % 100)::varchar, 2, '0') || '-'
    || CASE o_orderstatus WHEN 'O' THEN 'sw' WHEN 'F' THEN 'sc' ELSE 'cr' END || '-'
    || lpad(o_custkey::varchar, greatest(5, length(o_custkey::varchar))::int, '0')"""

_SQL_DOCKET_RAW = f"""
SELECT o_orderkey AS entry_id, 'c' || c_nationkey AS court, c_nationkey AS nation_key, o_orderdate AS pub_date,
  {_SQL_CASE_NUMBER} || CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE ' USA v. ' || CASE o_orderkey % 4
    WHEN 0 THEN 'Black phone' WHEN 1 THEN 'One parcel &amp; contents' WHEN 2 THEN 'Silver car' ELSE c_name END
    END AS title,
  '[' || CASE left(o_orderpriority, 1) WHEN '1' THEN 'Application for Search/Seizure Warrant'
    WHEN '2' THEN 'Order on Motion to Unseal Case' WHEN '3' THEN 'Notice (Other)'
    WHEN '4' THEN 'Case Assigned/Reassigned' ELSE 'Order' END || '] '
    || CASE WHEN left(o_orderpriority, 1) = '5' THEN '' ELSE
      '(<a href="https://ecf.c' || c_nationkey || '.example.gov/doc1/' || o_orderkey || '?caseid=' || o_custkey
      || CASE WHEN o_orderkey % 7 <> 0 THEN '&de_seq_num=' || (o_orderkey % 997) ELSE '' END || '" >'
      || CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE (o_orderkey % 89)::varchar END || '</a>)' END AS description,
  'https://ecf.c' || c_nationkey || '.example.gov/cgi-bin/DktRpt.pl?' || o_custkey AS link,
  'https://ecf.c' || c_nationkey || '.example.gov/cgi-bin/DktRpt.pl?' || o_custkey || '&e=' || o_orderkey AS guid,
  o_orderdate + INTERVAL 1 DAY AS scrape_date
FROM orders JOIN customer ON o_custkey = c_custkey"""

_SQL_DOCKET = """
SELECT entry_id, nation_key, u.title, split_part(u.title, ' ', 1) AS case_number,
  CASE WHEN strpos(u.title, ' ') > 0 THEN substr(u.title, strpos(u.title, ' ') + 1) END AS case_name,
  try_cast(split_part(link, '?', -1) AS int) AS docket_id, description,
  rtrim(ltrim(trim(split_part(description, '(', 1)), '['), ']') AS document_type,
  guid, pub_date, court, scrape_date,
  CASE WHEN contains(description, '(<a') THEN
    try_cast(nullif(regexp_extract(description, '[?&]de_seq_num=([^&"]+)', 1), '') AS int) END AS docket_entry_seq_num,
  CASE WHEN contains(description, '(<a') THEN
    try_cast(regexp_extract(description, '>([^<]*)</a>', 1) AS int) END AS docket_entry_num
FROM (SELECT * EXCLUDE (title), replace(title, '&amp;', '&') AS title FROM docket_raw) u"""

_SQL_PREDICTIONS = f"""
SELECT {_SQL_CASE_NUMBER} AS case_number, o_orderdate AS pub_date,
  CASE WHEN l_returnflag = 'R' THEN 'swornot' ELSE 'other' END AS prediction_type,
  l_linestatus = 'O' AS prediction_value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


# --- search results from orders, customers and parts --------------------------------------------------------------

SEARCH_PREFIX = {"O": "Search warrant returned executed for ", "F": "Motion to unseal docket about ",
                 "P": "Application for seizure warrant for "}


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """Document-search results, one per order; the item is the part of the customer's number."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    prefix = F.create_map(*[F.lit(x) for pair in SEARCH_PREFIX.items() for x in pair])
    items = customers.join(parts, F.col("c_custkey") == F.col("p_partkey"))
    return orders.join(items, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc_order"),
        F.concat(F.lit("/docket/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("absolute_url"),
        F.concat(F.lit("In re "), F.col("c_name")).alias("caseName"),
        F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("court_id"),
        F.concat(F.element_at(prefix, F.col("o_orderstatus")), F.col("p_name")).alias("description"),
        F.col("o_orderdate").alias("date_filed"), F.col("c_mktsegment").alias("suit_nature"),
        (F.col("o_orderstatus") != "P").alias("is_available"))


_SQL_SEARCH_RESULTS = """
SELECT o_orderkey AS doc_order, '/docket/' || o_orderkey || '/' AS absolute_url, 'In re ' || c_name AS caseName,
  'c' || c_nationkey AS court_id, CASE o_orderstatus WHEN 'O' THEN 'Search warrant returned executed for '
    WHEN 'F' THEN 'Motion to unseal docket about ' WHEN 'P' THEN 'Application for seizure warrant for ' END || p_name
    AS description,
  o_orderdate AS date_filed, c_mktsegment AS suit_nature, o_orderstatus <> 'P' AS is_available
FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON c_custkey = p_partkey"""


# --- tagged sentences from conversations --------------------------------------------------------------------------

WORD_CLASS = {"the": "phone", "The": "phone", "of": "car", "and": "package", "in": "online account",
              "is": "online account", "de": "money", "la": "money", "der": "person", "que": "person"}
MISALIGNED_CLASS = "money"
LOOKED_UP_CLASSES = ["car", "package", "person"]
SPAN_LABELS = {"of": "car", "of of": "car", "and": "package", "que": "person"}
MARKER_PAIR = ("of", "the")


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """One sentence per conversation turn, with raw tags as a label tool exports them (B and I only)."""
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("sent_id"), "role", words(F.col("text")).alias("words"))
    return turns.withColumn("tags", raw_tags(F.col("words"), WORD_CLASS))


def raw_tags(tokens: Column, word_class: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in word_class.items() for x in pair])
    classes = F.transform(tokens, lambda w: F.try_element_at(lookup, w))

    def tag(c: Column, before: Column, i: Column) -> Column:
        return F.when(c.isNull(), "O").when((i > 0) & (c == before), F.concat(F.lit("I-"), c)) \
            .otherwise(F.concat(F.lit("B-"), c))

    return let(classes, lambda cs: F.transform(cs, lambda c, i: tag(c, F.get(cs, i - 1), i)))


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated examples: text, token and span offsets, answer by role.

    Some classes are left to a later lookup by text; one class has spans that end
    inside their last token. System turns are rejected, and have no spans.
    """
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("sent_id"), "role",
        F.translate("text", "\n\t\r", "   ").alias("text"))
    tokens = turns.withColumn("tokens", S.with_offsets(F.split("text", " ")))

    def char_span(words_held: Column, s: Column) -> Column:
        last = F.get(words_held, s["end"] - 1)["end"]
        end = F.when(s["tag"] == MISALIGNED_CLASS, last - 1).otherwise(last)
        label = F.when(s["tag"].isin(LOOKED_UP_CLASSES), "OBJ").otherwise(s["tag"])
        return F.struct(F.get(words_held, s["start"])["start"].alias("start"), end.alias("end"), label.alias("label"))

    def char_spans(held: Column) -> Column:
        found = let(F.transform(held, lambda t: t["text"]), lambda plain: S.decode_spans(plain, raw_tags(plain, WORD_CLASS)))
        return F.transform(found, lambda s: char_span(held, s))

    is_system = F.col("role") == "system"
    return tokens.withColumns({
        "spans": F.when(~is_system, let(F.col("tokens"), char_spans)),
        "answer": F.when(is_system, "reject").otherwise("accept")})


def span_labels(spark: SparkSession) -> DataFrame:
    """Token → label table as read from a hand-labelled file: four fixed rows."""
    rows = [F.struct(F.lit(t).alias("token"), F.lit(c).alias("label")) for t, c in SPAN_LABELS.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _sql_case(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


SQL_WORDS = "list_filter(string_split(translate(text, chr(10) || chr(9) || chr(13), '   '), ' '), lambda w: w <> '')"

_SQL_SENTENCES = f"SELECT conv_id || '/' || turn AS sent_id, role, {SQL_WORDS} AS words FROM conversations"
_SQL_TOKENS = """
SELECT sent_id, role, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM sentences"""
_SQL_CLASSED = f"""
SELECT sent_id, role, pos, token, class, class IS NOT DISTINCT FROM lag(class) OVER s AND class IS NOT NULL AS goes_on,
  class IS NOT DISTINCT FROM lead(class) OVER s AND class IS NOT NULL AS is_continued
FROM (SELECT *, {_sql_case('token', WORD_CLASS)} AS class FROM tokens)
WINDOW s AS (PARTITION BY sent_id ORDER BY pos)"""
_SQL_RAW_TAGS = """
SELECT sent_id, role, pos, token, class, CASE WHEN class IS NULL THEN 'O' WHEN goes_on THEN 'I-' || class
  ELSE 'B-' || class END AS tag FROM classed"""
_SQL_RUNS = """
SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY sent_id ORDER BY pos) AS run FROM classed"""
_SQL_SPANS = """
SELECT sent_id, role, class, min(pos) AS start_pos, max(pos) + 1 AS end_pos, string_agg(token, ' ' ORDER BY pos) AS text
FROM runs WHERE class IS NOT NULL GROUP BY sent_id, role, class, run"""

SQL_VIEWS = {
    "docket_raw": _SQL_DOCKET_RAW, "docket": _SQL_DOCKET, "predictions": _SQL_PREDICTIONS,
    "search_results": _SQL_SEARCH_RESULTS, "sentences": _SQL_SENTENCES, "tokens": _SQL_TOKENS,
    "classed": _SQL_CLASSED, "raw_tags": _SQL_RAW_TAGS, "runs": _SQL_RUNS, "spans": _SQL_SPANS,
}
_NEEDS = {
    "docket": ["docket_raw"], "tokens": ["sentences"], "classed": ["tokens"], "raw_tags": ["classed"],
    "runs": ["classed"], "spans": ["runs"],
}


def with_views(names: str, sql: str, **more: str) -> str:
    """``sql`` with the named views (and what they build on) as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in ordered] + [f"{n} AS ({body})" for n, body in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + sql
