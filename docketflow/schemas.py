"""Table schemas. Fixed everywhere; nothing is inferred."""

from pyspark.sql import types as T

_S, _I, _NTZ, _B = T.StringType(), T.IntegerType(), T.TimestampNTZType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


DOCKET_KEY = ["case_number", "pub_date"]

DOCKET = _struct(
    ("title", _S), ("case_number", _S), ("case_name", _S), ("docket_id", _I), ("description", _S),
    ("document_type", _S), ("guid", _S), ("pub_date", _NTZ), ("court", _S), ("scrape_date", _NTZ),
    ("docket_entry_seq_num", _I), ("docket_entry_num", _I),
)

_CLASS_VALUE = [("prediction_type", _S), ("prediction_value", _B), ("likelihood", T.DoubleType())]
_ENTITY_VALUE = [("prediction_type", _S), ("prediction_value", _S), ("prediction_substring", _S)]

CLASS_LOG = _struct(("log_key", _S), ("case_number", _S), ("pub_date", _NTZ), *_CLASS_VALUE)
ENTITY_LOG = _struct(("log_key", _S), ("case_number", _S), ("pub_date", _NTZ), *_ENTITY_VALUE)
URL_CLASS_LOG = _struct(("log_key", _S), ("absolute_url", _S), *_CLASS_VALUE)
URL_ENTITY_LOG = _struct(("log_key", _S), ("absolute_url", _S), *_ENTITY_VALUE)

_MONTH = (DOCKET_KEY, {"pub_month": "date_format(pub_date, 'yyyy-MM')"})
_ADDRESS = (["absolute_url"], {"url_part": "substring(md5(absolute_url), 1, 1)"})

# Tables a new warehouse needs: columns, the key rows are found by, and how partition columns follow from a row.
TABLES = {
    "rss_docket_entries": (DOCKET, *_MONTH),
    "predictions": (CLASS_LOG, *_MONTH),
    "ner_predictions": (ENTITY_LOG, *_MONTH),
    "courtlistener_predictions": (URL_CLASS_LOG, *_ADDRESS),
    "courtlistener_ner_predictions": (URL_ENTITY_LOG, *_ADDRESS),
}


def ddl(schema: T.StructType) -> list[str]:
    """Column definitions of a schema."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]


FEED_ITEM = _struct(("title", _S), ("link", _S), ("description", _S), ("guid", _S), ("pubDate", _S))
# The last column takes what cannot be parsed.
FEED_SNAPSHOT = T.StructType([*FEED_ITEM.fields, T.StructField("_corrupt_record", _S, True)])

SEARCH_RESULT = _struct(("absolute_url", _S), ("caseName", _S), ("court_id", _S), ("description", _S),
                        ("dateFiled", _NTZ))
SEARCH_PAGE = T.StructType([
    T.StructField("results", T.ArrayType(SEARCH_RESULT), True),
    T.StructField("next", _S, True),
])

ANNOTATION = T.StructType([
    T.StructField("id", _S, True),
    T.StructField("text", _S, True),
    T.StructField("tokens", T.ArrayType(_struct(("text", _S), ("start", _I), ("end", _I), ("id", _I))), True),
    T.StructField("spans", T.ArrayType(_struct(("start", _I), ("end", _I), ("label", _S))), True),
    T.StructField("answer", _S, True),
])

PRESS_RELEASE = _struct(("date", _S), ("title", _S), ("doc_url", _S), ("host_url", _S))
TOKEN_LABEL = _struct(("token", _S), ("label", _S))
NUMBERED_TOKEN_LABEL = T.StructType([*TOKEN_LABEL.fields, T.StructField("row_no", T.LongType())])
LABELLED_DOCKET = _struct(
    ("row_no", _I), ("case_name", _S), ("document_type", _S), ("case_number", _S), ("court", _S),
    ("is_search_warrant", _B),
)
