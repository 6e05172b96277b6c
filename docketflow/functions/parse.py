"""Parsing of feed entries, addresses and case numbers into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketflow.fixed_values import ARCHIVE_HOST, ARCHIVE_PREFIXES
from docketflow.functions.text import let, strip_whitespace

# Zone names of feed dates and their offset from UTC in hours.
ZONE_HOURS = {
    "GMT": 0, "UT": 0, "UTC": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7,
}

_CASE_NUMBER = r"^(\d+):(\d{2})-([a-z]+)-(\d+)(?:-(\d+))?$"
_HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_ANCHOR_TEXT = r"(?is)<a\b[^>]*>(.*?)</a>"


def document_type(description: Column, full: bool = False) -> Column:
    """Leading ``[type]`` of a description.

    The type ends at the first ``(``, so one that holds a parenthesis itself is
    cut there; ``full=True`` keeps it up to the link instead.
    """
    head = F.regexp_extract(description, r"(?s)^(.*?)(?:\(<a|$)", 1) if full \
        else F.substring_index(description, "(", 1)
    return F.rtrim(F.ltrim(strip_whitespace(head), F.lit("[")), F.lit("]"))


def case_number(title: Column) -> Column:
    return F.substring_index(title, " ", 1)


def case_name(title: Column) -> Column:
    """Title after its first space; null without one."""
    return F.get(F.split(title, " ", 2), F.lit(1))


def has_link(description: Column) -> Column:
    return F.contains(description, F.lit("(<a"))


def _link_part(description: Column) -> Column:
    start = F.instr(description, "(")
    return F.when(has_link(description), F.substr(description, start + F.lit(1)))


def first_anchor_href(html: Column) -> Column:
    groups = [F.nullif(F.regexp_extract(html, _HREF, k), F.lit("")) for k in (1, 2, 3)]
    return F.replace(F.coalesce(*groups), F.lit("&amp;"), F.lit("&"))


def first_anchor_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(html, _ANCHOR_TEXT, 1), r"<[^>]*>", "")


def query_parameter(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter, decoded; null when absent."""
    raw = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*?&)?{name}=([^&#]+)", 1)
    return F.try_url_decode(F.nullif(raw, F.lit("")))


def entry_seq_text(description: Column) -> Column:
    return query_parameter(first_anchor_href(_link_part(description)), "de_seq_num")


def entry_seq_number(description: Column) -> Column:
    return entry_seq_text(description).try_cast("int")


def entry_number_text(description: Column) -> Column:
    return F.when(has_link(description), first_anchor_text(_link_part(description)))


def entry_number(description: Column) -> Column:
    return entry_number_text(description).try_cast("int")


def docket_id(link: Column) -> Column:
    return F.substring_index(link, "?", -1).try_cast("int")


def feed_time(text: Column) -> Column:
    """RFC 822 date as UTC wall clock without zone; null when it does not parse.

    Independent of the session time zone: the zone is applied by arithmetic.
    """
    return let(strip_whitespace(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", "")), _utc_time)


def _utc_time(body: Column) -> Column:
    stamp = let(F.regexp_extract(body, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?)", 1), lambda found: F.when(
        F.length(F.regexp_extract(found, r"(:\d{2}){2}$", 0)) > 0, found).otherwise(F.concat(found, F.lit(":00"))))
    # Read as if UTC: the literal zone keeps the session zone out of the result.
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(stamp, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z")))
    offset = let(F.upper(F.regexp_extract(body, r"\s([A-Za-z]{1,4}|[+-]\d{4})$", 1)), _offset_minutes)
    return ntz_from_seconds(seconds - offset * 60)


def _offset_minutes(zone: Column) -> Column:
    numeric = zone.rlike(r"^[+-]\d{4}$")
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    named = F.lit(None).cast("int")
    for name, hours in ZONE_HOURS.items():
        named = F.when(zone == name, F.lit(hours * 60)).otherwise(named)
    return F.when(numeric, sign * minutes).when(zone == "", F.lit(0)).otherwise(named)


def ntz_from_seconds(seconds: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def case_number_facets(number: Column) -> list[Column]:
    """Office, year, case type, serial and defendant of a docket number."""
    names = ["office", "filed_year", "case_type", "serial", "defendant"]
    return [F.nullif(F.regexp_extract(number, _CASE_NUMBER, k + 1), F.lit("")).alias(name)
            for k, name in enumerate(names)]


def archive_url(path: Column) -> Column:
    """Every storage prefix becomes the archive's host."""
    for prefix in ARCHIVE_PREFIXES:
        path = F.replace(path, F.lit(prefix), F.lit(ARCHIVE_HOST))
    return path


def archive_path(url: Column, kind: str = "other") -> Column:
    return F.concat(F.lit(f"{kind}/"), F.substring_index(url, "/", -1))


def absolute_url(path: Column, host: str = ARCHIVE_HOST) -> Column:
    """Address of an archive path; a null path stays null."""
    return F.concat(F.lit(host), path)


def entry_address(guid: Column) -> Column:
    return F.substring_index(guid, "&", 1)


def url_segment(url: Column, position: int) -> Column:
    """``/``-separated segment counted from the end (-1 = last), null when absent."""
    parts = F.split(url, "/")
    return F.when(F.size(parts) >= abs(position), F.try_element_at(parts, F.lit(position)))


def pdf_path(doc_url: Column, host_url: Column) -> Column:
    """Target path of a press-release attachment; null for malformed addresses."""
    return F.concat(F.lit("pdfs/"), url_segment(host_url, -1), F.lit("/"), url_segment(doc_url, -2), F.lit(".pdf"))

