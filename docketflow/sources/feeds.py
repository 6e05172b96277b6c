"""Feed snapshots and the court dimension."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow import schemas
from docketflow.fixed_values import BANKRUPTCY_COURTS, DISTRICT_COURTS, FEED_URL
from docketflow.functions import parse
from docketflow.functions.text import html_unescape

_COURT_IN_PATH = r"/court=([^/]+)/"
_CORRUPT = schemas.FEED_SNAPSHOT.names[-1]
BROKEN = "broken"
BROKEN_CHARS = 200


def courts(spark: SparkSession) -> DataFrame:
    """All courts with a feed: ``court, court_type, feed_url`` (161 fixed rows, safe to broadcast)."""
    def listed(codes: list[str], court_type: str) -> DataFrame:
        exploded = spark.range(1).select(F.explode(F.array(*map(F.lit, codes))).alias("court"))
        return exploded.withColumn("court_type", F.lit(court_type))

    both = listed(DISTRICT_COURTS, "district").unionByName(listed(BANKRUPTCY_COURTS, "bankruptcy"))
    return both.withColumn("feed_url", F.replace(F.lit(FEED_URL), F.lit("{court}"), F.col("court")))


def _reader(reader):
    """Options of both readers: what cannot be parsed becomes a row of its own and never fails the read."""
    return reader.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", _CORRUPT).schema(schemas.FEED_SNAPSHOT)


def read_feed_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed snapshots ``<path>/court=<code>/*.xml``, one row per ``<item>``.

    A snapshot that is cut off or malformed gives the entries before the fault, and one row whose ``broken``
    holds the beginning of the file; of whole entries ``broken`` is null.
    """
    return _feed_columns(_reader(spark.read).load(path))


def stream_feed_snapshots(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = _reader(spark.readStream)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _feed_columns(reader.load(path))


def _feed_columns(items: DataFrame) -> DataFrame:
    landed = F.col("_metadata.file_modification_time")
    # What cannot be parsed has no fields; asking for them also keeps the reader from being asked for the fault alone.
    broken = F.when(F.col("title").isNull() & F.col("guid").isNull(), F.substring(_CORRUPT, 1, BROKEN_CHARS))
    return items.select(
        "title", "link", "description", "guid", F.col("pubDate").alias("published"),
        F.regexp_extract("_metadata.file_path", _COURT_IN_PATH, 1).alias("court"),
        parse.ntz_from_seconds(F.unix_micros(landed) / F.lit(1_000_000)).alias("scrape_date"),
        F.col("_metadata.file_path").alias("snapshot"), broken.alias(BROKEN),
    )


def whole_entries(entries: DataFrame) -> DataFrame:
    """Entries without the rows that stand for broken snapshots."""
    return entries.where(F.col(BROKEN).isNull()) if BROKEN in entries.columns else entries


def normalise_entries(
    entries: DataFrame, unescape: Callable[[Column], Column] = html_unescape, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Feed entries → docket rows. Narrow: no shuffle.

    Needs title, link, description, guid, court, scrape_date and either
    ``pub_date`` or the feed's ``published`` text. ``keep`` names extra columns.
    Broken snapshots give no rows.
    """
    entries = whole_entries(entries)
    pub_date = F.col("pub_date") if "pub_date" in entries.columns else parse.feed_time(F.col("published"))
    clean = entries.withColumns({
        "title": unescape(F.col("title")), "description": unescape(F.col("description")), "pub_date": pub_date,
    })
    title, description = F.col("title"), F.col("description")
    parsed = {
        "case_number": parse.case_number(title),
        "case_name": parse.case_name(title),
        "docket_id": parse.docket_id(F.col("link")),
        "document_type": parse.document_type(description),
        "docket_entry_seq_num": parse.entry_seq_number(description),
        "docket_entry_num": parse.entry_number(description),
    }
    return clean.withColumns(parsed).select(*keep, *schemas.DOCKET.names)


def feed_quarantine(entries: DataFrame, unescape: Callable[[Column], Column] = html_unescape) -> DataFrame:
    """One row per entry and rule it breaks: guid, court, rule, offending text.

    A broken snapshot is one row, of the rule ``snapshot``.
    """
    description = unescape(F.col("description"))
    number_text = parse.entry_number_text(description)
    seq_text = parse.entry_seq_text(description)
    published = F.col("published") if "published" in entries.columns else F.col("pub_date").cast("string")
    when_parsed = F.col("pub_date") if "pub_date" in entries.columns else parse.feed_time(F.col("published"))
    checks = {
        "docket_id": (parse.docket_id(F.col("link")).isNull() & F.col("link").isNotNull(), F.col("link")),
        "docket_entry_seq_num": (seq_text.isNotNull() & seq_text.try_cast("int").isNull(), seq_text),
        "docket_entry_num": (number_text.isNotNull() & number_text.try_cast("int").isNull(), number_text),
        "pub_date": (when_parsed.isNull(), published),
        "case_number": (F.coalesce(parse.case_number(F.col("title")), F.lit("")) == "", F.col("title")),
    }
    broken = F.col(BROKEN) if BROKEN in entries.columns else F.lit(None).cast("string")
    checks = {rule: (bad & broken.isNull(), text) for rule, (bad, text) in checks.items()} | {"snapshot": (broken.isNotNull(), broken)}
    rows = F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), text.alias("text")))
                     for rule, (bad, text) in checks.items()])
    return entries.select("guid", "court", F.explode(F.array_compact(rows)).alias("q")).select("guid", "court", "q.*")
