"""Queries: token corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import spans as S
from docketflow.functions.text import canonical_label
from docketflow.operators import corpus
from docketflow.plans import corpus_build
from docketflow.plans.adapters import (
    LOOKED_UP_CLASSES, MARKER_PAIR, MISALIGNED_CLASS, SPAN_LABELS, annotations, sentences, span_labels, table,
    with_views,
)
from docketflow.plans.registry import query
from docketflow.session import cut_lineage
from docketflow.sources.corpora import token_rows

_TOKEN = "sent_id, pos, token, tag"

# Tags of annotated sentences: B, I, E inside, S alone, '-' under a misaligned span.
_SQL_TAGGED = f"""
SELECT sent_id, role, pos, token, class, CASE WHEN class IS NULL OR role = 'system' THEN 'O'
  WHEN class = '{MISALIGNED_CLASS}' THEN '-'
  ELSE CASE WHEN goes_on AND is_continued THEN 'I-' WHEN goes_on THEN 'E-' WHEN is_continued THEN 'B-' ELSE 'S-' END
    || {{label}} END AS tag FROM {{source}}"""
_OBJ = "CASE WHEN class IN ('" + "', '".join(LOOKED_UP_CLASSES) + "') THEN 'OBJ' ELSE class END"


@query("tokens_bioes", with_views("classed", _SQL_TAGGED.format(label=_OBJ, source="classed").replace(
    "SELECT sent_id, role, pos, token, class, CASE", "SELECT sent_id, pos, token, CASE", 1)))
def tokens_bioes(spark, d):
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    # Stored like the examples of a corpus build: the planner loses Arrow functions above nested lambda expressions.
    examples = cut_lineage(annotations(spark, d).withColumn("spans", F.coalesce("spans", empty)))
    return token_rows(corpus.tagged_sentences(examples, "sent_id"))


_REPAIRED = """SELECT sent_id, pos, token, class, CASE WHEN class IS NULL THEN 'O' ELSE upper(replace(CASE WHEN NOT goes_on
  THEN 'B-' WHEN is_continued THEN 'I-' ELSE 'E-' END || class, ' ', '_')) END AS tag FROM classed"""


@query("raw_tags_repair", with_views("classed", f"SELECT {_TOKEN} FROM ({_REPAIRED})"))
def raw_tags_repair(spark, d):
    return token_rows(corpus.repaired_export(sentences(spark, d)))


@query("span_decode", with_views("spans", """
SELECT sent_id, start_pos, end_pos, text, upper(replace(class, ' ', '_')) AS tag FROM spans"""))
def span_decode(spark, d):
    repaired = corpus.repaired_export(sentences(spark, d))
    decoded = repaired.select("sent_id", F.explode(S.decode_spans(F.col("words"), F.col("tags"))).alias("s"))
    return decoded.select("sent_id", F.col("s.start").cast("bigint").alias("start_pos"),
                          F.col("s.end").cast("bigint").alias("end_pos"), "s.text", "s.tag")


def _sql_variants(source: str) -> dict[str, str]:
    """The original sentences and their variants after the marker, as token rows of ``source``."""
    first, second = MARKER_PAIR
    return {
        "joined": f"SELECT sent_id, string_agg(token, ' ' ORDER BY pos) AS text FROM {source} GROUP BY 1",
        "before": f"""SELECT s.*, last_value(CASE WHEN token <> '{second}' THEN token END IGNORE NULLS) OVER
          (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
          FROM {source} s JOIN joined USING (sent_id) WHERE contains(text, '{first} {second}')""",
        "marked": f"SELECT *, token = '{second}' AND previous IS NOT DISTINCT FROM '{first}' AS hit FROM before",
        "after": """SELECT *, min(CASE WHEN hit THEN pos END) OVER (PARTITION BY sent_id) AS first_hit FROM marked""",
        "pieces": """SELECT sent_id, pos, 0 AS piece, CASE WHEN hit THEN 'USA' ELSE token END AS token,
            CASE WHEN hit THEN 'O' ELSE tag END AS tag FROM after WHERE pos >= first_hit
          UNION ALL SELECT sent_id, pos, 1, 'v.', 'O' FROM after WHERE hit AND pos >= first_hit""",
        "variants": f"""SELECT sent_id, 0 AS variant, pos, token, tag FROM {source}
          UNION ALL SELECT sent_id, 1, row_number() OVER (PARTITION BY sent_id ORDER BY pos, piece) - 1, token, tag
          FROM pieces""",
    }


@query("augment_marker", with_views("raw_tags", f"SELECT variant, {_TOKEN} FROM variants", **_sql_variants("raw_tags")))
def augment_marker(spark, d):
    return token_rows(corpus.with_marker_variants(sentences(spark, d), MARKER_PAIR), "variant")


def _sql_split(key: str) -> str:
    draw = f"('0x' || substr(md5({key}), 1, 8))::bigint / 4294967296.0::double"
    return f"CASE WHEN {draw} < 0.8 THEN 'train' WHEN {draw} < 0.9 THEN 'dev' ELSE 'test' END"


@query("corpus_split", f"""
SELECT 'documents' AS source, doc_id AS key, {_sql_split("doc_id::varchar")} AS split FROM documents
UNION ALL SELECT 'benchmark', item_id, {_sql_split("item_id::varchar")} FROM benchmark""")
def corpus_split(spark, d):
    def keyed(name, key):
        return table(spark, d, name).select(F.lit(name).alias("source"), F.col(key).alias("key"),
                                            corpus.split_name(F.col(key).cast("string")).alias("split"))
    return keyed("documents", "doc_id").unionByName(keyed("benchmark", "item_id"))


_LOOKED_UP = "CASE WHEN class IN ('" + "', '".join(LOOKED_UP_CLASSES) + "') THEN coalesce(CASE text " + " ".join(
    f"WHEN '{t}' THEN '{c}'" for t, c in SPAN_LABELS.items()) + " END, 'MISC') ELSE class END"
_ANNOTATED = {
    "labelled": f"""SELECT sent_id, start_pos, end_pos, {_LOOKED_UP} AS label FROM spans""",
    "accepted": """SELECT c.*, label FROM classed c LEFT JOIN labelled l ON c.sent_id = l.sent_id AND pos >= start_pos
      AND pos < end_pos WHERE role <> 'system'""",
    "tagged": _SQL_TAGGED.format(label="label", source="accepted"),
    **_sql_variants("tagged"),
    "annotated": f"SELECT sent_id, {_sql_split('sent_id')} AS split, variant, pos, token, tag FROM variants",
}


def _annotated(spark, d):
    return corpus_build.from_annotations(annotations(spark, d), "sent_id", span_labels(spark), MARKER_PAIR)


@query("annotations_to_corpus", with_views("spans", f"SELECT split, variant, {_TOKEN} FROM annotated", **_ANNOTATED))
def annotations_to_corpus(spark, d):
    return token_rows(_annotated(spark, d), "split", "variant")


_COMBINED = {
    **_ANNOTATED, "repaired": _REPAIRED,
    "combined": f"""SELECT 'annotations' AS source, split, sent_id, variant, pos, token, tag FROM annotated
      UNION ALL SELECT 'export', {_sql_split('sent_id')}, sent_id, 0, pos, token, tag FROM repaired""",
}


def _combined(spark, d):
    return corpus_build.combined(_annotated(spark, d), corpus_build.from_export(sentences(spark, d)))


@query("corpus_union", with_views("spans", """
SELECT source, split, count(*) AS n_sentences, sum(n)::bigint AS n_tokens, count(*) FILTER (e > 0) AS n_with_entities
FROM (SELECT source, split, sent_id, variant, count(*) AS n, count(*) FILTER (tag <> 'O') AS e FROM combined
  GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""", **_COMBINED))
def corpus_union(spark, d):
    return corpus.sentence_counts(_combined(spark, d), "source", "split")


@query("corpus_profile", with_views("spans", """
SELECT source, split, CASE WHEN contains(tag, '-') AND length(tag) > 2 THEN substr(tag, 3) ELSE 'O' END AS class,
  count(*) AS n_tokens, count(*) FILTER (tag[1] IN ('B', 'S')) AS n_openers FROM combined GROUP BY 1, 2, 3""",
                                    **_COMBINED))
def corpus_profile(spark, d):
    return corpus.corpus_profile(_combined(spark, d), "source", "split")


@query("corpus_audit", with_views("spans", """
SELECT rule, count(*) AS n_tokens FROM (
  SELECT unnest(['unknown_tag', 'no_opener', 'no_end', 'suspect_class', 'blank_token']) AS rule, unnest([
    tag <> 'O' AND NOT (tag[1] IN ('B', 'I', 'E', 'S') AND tag[2] = '-'),
    tag[1] IN ('I', 'E') AND NOT coalesce(before[1] IN ('B', 'I') AND before[3:] = tag[3:], false),
    tag[1] IN ('B', 'I') AND NOT coalesce(after[1] IN ('I', 'E') AND after[3:] = tag[3:], false),
    tag[3:] IN ('MISTAKE', 'MULTIPLE'), trim(token) = '']) AS broken
  FROM (SELECT *, lag(tag) OVER s AS before, lead(tag) OVER s AS after FROM combined
    WINDOW s AS (PARTITION BY source, sent_id, variant ORDER BY pos))) WHERE broken GROUP BY 1""", **_COMBINED))
def corpus_audit(spark, d):
    return corpus.corpus_audit(_combined(spark, d))


@query("entity_export", with_views("spans", f"""
SELECT sent_id, (row_number() OVER (PARTITION BY sent_id ORDER BY start_pos) - 1) AS span_no,
  CASE WHEN class = '{MISALIGNED_CLASS}' THEN left(text, -1) ELSE text END AS token, '' AS label
FROM spans WHERE role <> 'system'"""))
def entity_export(spark, d):
    rows = corpus.exported_entities(annotations(spark, d), "sent_id")
    return rows.withColumn("span_no", F.col("span_no").cast("bigint"))


@query("annotation_lines", """
SELECT doc_id, '{"id":' || doc_id || ',"text":' || to_json(text) || '}' AS line FROM documents""")
def annotation_lines(spark, d):
    """Documents as JSON lines for an annotation tool."""
    documents = table(spark, d, "documents")
    return documents.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "text")).alias("line"))


@query("sample_per_group", """
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::varchar), doc_id) AS rank
FROM documents QUALIFY rank <= 10""")
def sample_per_group(spark, d):
    return corpus.sample_per_group(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("sample_matching", """
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::varchar), doc_id) AS rank
FROM documents WHERE text ILIKE '%license%' QUALIFY rank <= 10""")
def sample_matching(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return corpus.sample_per_group(documents, "source", "doc_id", 10, F.col("text").ilike("%license%")).drop("text")


@query("label_vocabulary", with_views("raw_tags", """
SELECT upper(replace(tag, ' ', '_')) AS label, count(*) AS n_tokens FROM raw_tags WHERE tag <> 'O' GROUP BY 1"""))
def label_vocabulary(spark, d):
    tags = sentences(spark, d).select(F.explode("tags").alias("tag")).where(F.col("tag") != "O")
    return tags.groupBy(canonical_label(F.col("tag")).alias("label")).agg(F.count(F.lit(1)).alias("n_tokens"))
