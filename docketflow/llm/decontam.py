r"""Benchmark decontamination with DataFrame functions only.

Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing A-Z. The windows of an item
are its runs of ``size`` consecutive words; an item of fewer words (but not none) is one window. The distinct windows are
a broadcast hash table. Hashing every window of every document would cost more than all the rest, so the table is keyed
by each window's longest word: a document's words are looked up as they are scanned, and where one is the longest word
of a window, the whole window around it is verified word by word. Nothing but verified hits leaves a scan task.

At most MAX_BROADCAST_WINDOWS windows are broadcast at once; a larger table is split by hash and takes as many passes
over the documents, so no text is ever shuffled.

A null text has no words and no hits. Rows are matched by id and content, so repeated ids, null ids and repeated rows
each get their own, right result. Without items no document has a hit.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows that may be broadcast; with 13 words of 8 letters each this is some 60 MB.
MAX_BROADCAST_WINDOWS = 200_000
SIZE = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null gives none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def item_windows(items: DataFrame, size: int = SIZE, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: w_words, w_items (the ids that hold it, as strings), w_anchor (its longest word), w_at (where)."""
    prepared = items.select(F.col(key).cast("string").alias("id"), words(F.col(text)).alias("words")) \
        .where(F.size("words") > 0).withColumn("len", F.least(F.lit(size), F.size("words")))
    each = prepared.select("id", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("pos"))
    distinct = each.select("id", F.slice("words", F.col("pos"), F.col("len")).alias("w_words")) \
        .groupBy("w_words").agg(F.collect_set("id").alias("w_items"))
    longest = F.array_max(F.transform("w_words", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("before"), w.alias("word"))))
    return distinct.withColumn("longest", longest) \
        .select("w_words", "w_items", F.col("longest.word").alias("w_anchor"), (-F.col("longest.before")).alias("w_at"))


def document_hits(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text",
                  max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Verified hits: d_key, d_mark (hash of the text), d_words (its words), pos (from 1), len, w_items."""
    passes = max(1, math.ceil(windows.count() / max_broadcast))
    found = docs.select(F.col(key).alias("d_key"), F.xxhash64(text).alias("d_mark"), words(F.col(text)).alias("words")) \
        .select("d_key", "d_mark", "words", F.posexplode("words").alias("p", "word"))
    pos, size = F.col("p") - F.col("w_at") + 1, F.size("w_words")
    around = F.slice("words", F.greatest(pos, F.lit(1)), size)
    # Two inequalities, because Spark would take an equality for a join key and cut a window out at every word.
    same = (F.col("word") == F.col("w_anchor")) & (pos >= 1) & (around <= F.col("w_words")) & (around >= F.col("w_words"))
    hits = None
    for i in range(passes):
        part = windows if passes == 1 else windows.where(F.pmod(F.xxhash64("w_words"), F.lit(passes)) == i)
        hit = found.join(F.broadcast(part), same).select(
            "d_key", "d_mark", F.size("words").cast("long").alias("d_words"), pos.alias("pos"), size.alias("len"), "w_items")
        hits = hit if hits is None else hits.union(hit)
    return hits


def hit_documents(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text",
                  max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Documents with a hit: h_key, h_mark (hash of the text), d_words, h_words (words hit, each once), h_items."""
    hits = document_hits(docs, item_windows(items, size, item_key, item_text), key, text, max_broadcast).distinct()
    ids = ["d_key", "d_mark", "d_words"]
    before = F.max(F.col("pos") + F.col("len")).over(
        Window.partitionBy(*ids).orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("pos") + F.col("len")
    return hits.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("pos"), F.coalesce(before, F.col("pos"))))) \
        .groupBy(*ids).agg(F.sum("new").cast("long").alias("h_words"),
                           F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("h_items")) \
        .withColumnsRenamed({"d_key": "h_key", "d_mark": "h_mark"})


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contaminated_keys(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text",
                      item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """h_key, h_mark of the contaminated documents; few, so a filter by them need not shuffle the texts."""
    marked = hit_documents(docs, items, size, key, text, item_key, item_text)
    return marked.where(is_contaminated(F.col("h_words"), F.col("d_words"))).select("h_key", "h_mark")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text",
                  max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of every document row; a word inside several hits counts once."""
    per_doc = hit_documents(docs, items, size, key, text, item_key, item_text, max_broadcast).drop("d_words")
    left = docs.select(key, F.xxhash64(text).alias("d_mark"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = left.join(per_doc, F.col(key).eqNullSafe(F.col("h_key")) & F.col("d_mark").eqNullSafe(F.col("h_mark")), "left")
    n_hit, held = F.coalesce("h_words", F.lit(0)).cast("long"), F.coalesce("h_items", F.array().cast("array<string>"))
    return joined.select(key, "n_words", n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"),
                         F.sha2(F.array_join(held, ","), 256).alias("items_sha256"),
                         is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM bi),
ls AS (SELECT DISTINCT l FROM bw),
di AS (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l),
dw AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM di),
hit AS (SELECT rid, item_id, dw.l, i FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
