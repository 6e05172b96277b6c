"""Building, repairing, splitting and profiling token-tagged corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.fixed_values import (
    DEFAULT_LABEL, DEV_SHARE, GENERIC_SPAN_LABEL, MARKER, MARKER_REPLACEMENT, TRAIN_SHARE,
)
from docketflow.functions import spans as S
from docketflow.functions.text import hash_fraction, let, span_text, tail
from docketflow.operators.ordering import top_per_group
from docketflow.session import cut_lineage

VALID_PREFIXES = ("B", "I", "E", "S")


def split_name(key: Column, train: float = TRAIN_SHARE, dev: float = DEV_SHARE) -> Column:
    """train / dev / test by a hash of the key: the same key always lands in the same split."""
    draw = hash_fraction(key)
    return F.when(draw < train, "train").when(draw < train + dev, "dev").otherwise("test")


def accepted(examples: DataFrame) -> DataFrame:
    """Annotations that were accepted and carry spans."""
    return examples.where((F.col("answer") == "accept") & F.col("spans").isNotNull())


def exported_entities(examples: DataFrame, *keep: str) -> DataFrame:
    """Text of every span of the accepted examples, repeats included, with an empty label to fill in."""
    exploded = accepted(examples).select(*keep, "text", F.posexplode("spans").alias("span_no", "s"))
    return exploded.select(*keep, "span_no",
                           span_text(F.col("text"), F.col("s.start"), F.col("s.end")).alias("token"),
                           F.lit("").alias("label"))


def lookup_span_labels(examples: DataFrame, labels: DataFrame) -> DataFrame:
    """Generic span labels become the class of their text in ``labels`` (token, label).

    Other labels stay; texts the table does not know get the default class; of a
    token listed twice the largest label counts. The examples are materialised once
    under row numbers, so examples may share a key; only the distinct texts of
    their generic spans are looked up.
    """
    rows = cut_lineage(examples.withColumn("_row", F.monotonically_increasing_id()))
    generic = rows.select("_row", "text", F.explode("spans").alias("s")).where(F.col("s.label") == GENERIC_SPAN_LABEL) \
        .select("_row", span_text(F.col("text"), F.col("s.start"), F.col("s.end")).alias("token")).distinct()
    known = labels.groupBy("token").agg(F.max("label").alias("label"))
    looked_up = generic.join(known, "token").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "label"))).alias("_known"))

    def labelled(s: Column) -> Column:
        found = F.try_element_at(F.col("_known"), span_text(F.col("text"), s["start"], s["end"]))
        label = F.when(s["label"] == GENERIC_SPAN_LABEL, F.coalesce(found, F.lit(DEFAULT_LABEL))).otherwise(s["label"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label"))

    return rows.join(looked_up, "_row", "left").withColumn("spans", F.transform("spans", labelled)).drop("_row", "_known")


def tagged_sentences(examples: DataFrame, *keep: str) -> DataFrame:
    """Annotated examples → words and BIOES tags."""
    return examples.select(
        *keep, F.transform("tokens", lambda t: t["text"]).alias("words"),
        S.to_bioes(S.biluo_tags(F.col("tokens"), F.col("spans"))).alias("tags"))


def with_marker_variants(sentences: DataFrame, marker: tuple[str, str] = MARKER,
                         replacement: list[str] | None = None) -> DataFrame:
    """Every sentence plus, where it holds the marker, its rewritten variant (``variant`` 1).

    Both come from one row, so they stay in one split. Text that holds the marker
    only inside longer words gives no variant.
    """
    replacement = MARKER_REPLACEMENT if replacement is None else replacement
    original = F.struct(F.lit(0).alias("variant"), F.col("words"), F.col("tags"))
    rewritten = S.rewrite_after_marker(F.col("words"), F.col("tags"), marker, replacement)
    variant = F.when(F.col("_r").isNotNull(), F.struct(
        F.lit(1).alias("variant"), F.transform("_r", lambda p: p["token"]).alias("words"),
        F.transform("_r", lambda p: p["tag"]).alias("tags")))
    kept = [c for c in sentences.columns if c not in ("words", "tags")]
    return sentences.withColumn("_r", rewritten) \
        .select(*kept, F.explode(F.array_compact(F.array(original, variant))).alias("_v")) \
        .select(*kept, "_v.variant", "_v.words", "_v.tags")


def repaired_export(sentences: DataFrame) -> DataFrame:
    """Label-tool sentences → BIOES tags with canonical labels."""
    return sentences.withColumn("tags", S.repair_raw_tags(F.col("tags")))


def union_corpora(**sources: DataFrame) -> DataFrame:
    """Corpora after one another with a ``source`` column; stray tags become outside tags."""
    combined = None
    for name, sentences in sources.items():
        part = sentences.withColumn("source", F.lit(name))
        combined = part if combined is None else combined.unionByName(part)
    return combined.withColumn("tags", S.repair_stray_tags(F.col("tags")))


def corpus_profile(sentences: DataFrame, *by: str) -> DataFrame:
    """Sentences, tokens and counts per class; tokens are counted per row before any shuffle."""
    tag_class = F.transform("tags", lambda t: F.when(F.contains(t, F.lit("-")) & (F.length(t) > 2), tail(t, 3))
                            .otherwise(F.lit("O")))
    rows = sentences.select(*by, "tags", F.explode(F.arrays_zip(F.col("tags").alias("t"), tag_class.alias("c")))
                            .alias("p"))
    return rows.groupBy(*by, F.col("p.c").alias("class")).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(F.substring("p.t", 1, 1).isin("B", "S")).alias("n_openers"))


def sentence_counts(sentences: DataFrame, *by: str) -> DataFrame:
    return sentences.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum(F.size("words").cast("bigint")).alias("n_tokens"),
        F.count_if(F.exists("tags", lambda t: t != "O")).alias("n_with_entities"))


def corpus_audit(sentences: DataFrame, suspect_classes: tuple[str, ...] = ("MISTAKE", "MULTIPLE")) -> DataFrame:
    """Counts per broken rule: unknown prefix, inside without opener, open end, suspect class, blank token.

    Each rule is checked on a tag and its neighbours inside the sentence.
    """
    def continues(tag: Column) -> Column:
        return F.substring(tag, 1, 1).isin("I", "E")

    def same_class(a: Column, b: Column) -> Column:
        return F.equal_null(tail(a, 3), tail(b, 3))

    def rules(tags: Column, words: Column, tag: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tags, i - 1))
        after = F.get(tags, i + 1)
        prefix = F.substring(tag, 1, 1)
        opened = F.coalesce(F.substring(before, 1, 1).isin("B", "I") & same_class(before, tag), F.lit(False))
        goes_on = F.coalesce(continues(after) & same_class(after, tag), F.lit(False))
        return F.array_compact(F.array(
            F.when((tag != "O") & ~(prefix.isin(*VALID_PREFIXES) & (F.substring(tag, 2, 1) == "-")), "unknown_tag"),
            F.when(continues(tag) & ~opened, "no_opener"),
            F.when(prefix.isin("B", "I") & ~goes_on, "no_end"),
            F.when(tail(tag, 3).isin(*suspect_classes), "suspect_class"),
            F.when(F.coalesce(F.trim(F.get(words, i)), F.lit("")) == "", "blank_token")))

    broken = let(F.struct("tags", "words"), lambda s: F.flatten(
        F.transform(s["tags"], lambda tag, i: rules(s["tags"], s["words"], tag, i))))
    return sentences.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_tokens"))


def sample_per_group(df: DataFrame, group: str, key: str, k: int = 10, condition: Column | None = None) -> DataFrame:
    """``k`` rows of every group, chosen by a hash of their key."""
    rows = df if condition is None else df.where(condition)
    hashed = rows.withColumn("_h", F.md5(F.col(key).cast("string")))
    return top_per_group(hashed, [group], [F.asc("_h"), F.asc(key)], k).drop("_h")
