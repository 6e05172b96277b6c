"""Keyed upserts, prediction logs and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.operators.ordering import first_per_key, number_rows
from docketflow.operators.select import with_match, without_match
from docketflow.schemas import DOCKET_KEY
from docketflow.sources.tables import Table



def latest_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of every key by ``order``; its nulls overwrite older values."""
    return first_per_key(rows, keys, [F.desc_nulls_last(c) for c in order])


def has_key(keys: list[str]) -> Column:
    """True for rows that an upsert can merge."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return complete


def rejected(batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch that no upsert can merge, because a part of their key is null."""
    return batch.where(~has_key(keys))


def upsert(table: Table, batch: DataFrame, keys: list[str], order: list[str], position: str) -> None:
    """Merge a batch into a table: the row that is newest by ``order``, then by batch position, wins.

    Reads and writes only the partitions the batch touches; the partition column
    has to follow from the key. Rows of :func:`rejected` stay out; callers keep them.
    The batch is read several times, so it should be a stored one.
    """
    complete = batch.where(has_key(keys))
    touched = table.touched(table.placed(complete))
    if not touched:
        return
    columns = [*table.schema.names, *[k for k in keys if k not in table.schema.names]]
    held = table.read(touched).select(*columns, F.lit(-1).cast("bigint").alias(position))
    both = held.unionByName(complete.select(*columns, position))
    table.replace(latest_per_key(both, keys, *order, position), touched)


def upsert_docket(table: Table, batch: DataFrame, position: str) -> None:
    """Merge scraped entries: the later scrape wins, then the later position in the batch.

    An entry's key holds its publication time, so it never changes its month.
    """
    upsert(table, batch, DOCKET_KEY, ["scrape_date"], position)


def log_key(prediction_type: str, *columns: str) -> Column:
    """Deterministic key of a log row, in place of a serial number.

    A null part counts as empty text, so it still separates its neighbours.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *parts, F.lit(prediction_type)))


def class_log_rows(scored: DataFrame, keys: list[str], prediction_type: str) -> DataFrame:
    """One log row per scored entry, positive or not, so that none is scored again."""
    return scored.select(
        log_key(prediction_type, *keys).alias("log_key"), *keys, F.lit(prediction_type).alias("prediction_type"),
        F.col("predicted_class").cast("boolean").alias("prediction_value"), "likelihood")


def entity_log_rows(entities: DataFrame, keys: list[str], prediction_type: str) -> DataFrame:
    """One log row per entity kept, or one with a null text where none was found."""
    return entities.select(
        log_key(prediction_type, *keys, "span_pos").alias("log_key"), *keys,
        F.lit(prediction_type).alias("prediction_type"), F.col("category").alias("prediction_value"),
        F.col("thing_searched").alias("prediction_substring"))


def purge_keep(docket: DataFrame, predictions: DataFrame, scraped_until=None) -> DataFrame:
    """Entries that stay: those with a prediction of any type.

    With ``scraped_until``, entries scraped after it stay too: they may have
    landed after the run that scored the others. Without it the plain rule holds.
    """
    kept = with_match(docket if scraped_until is None else docket.where(F.col("scrape_date") <= scraped_until),
                      predictions, DOCKET_KEY)
    if scraped_until is None:
        return kept
    return kept.unionByName(docket.where((F.col("scrape_date") > scraped_until) | F.col("scrape_date").isNull()))


def purge_removed(docket: DataFrame, predictions: DataFrame, scraped_until=None) -> DataFrame:
    """Entries a purge deletes."""
    rows = docket if scraped_until is None else docket.where(F.col("scrape_date") <= scraped_until)
    return without_match(rows, predictions, DOCKET_KEY)


def purge_docket(table: Table, predictions: DataFrame, scraped_until=None, only: list[tuple[str, ...]] | None = None) -> None:
    """Rewrite the partitions that lose entries; emptied ones leave the table. ``only`` limits the purge to partitions."""
    touched = table.partitions_of(purge_removed(table.read(only), predictions, scraped_until))   # keys and times alone are read
    if touched:
        table.replace(purge_keep(table.read(touched), predictions, scraped_until), touched)


def entries_with_counts(docket: DataFrame, class_log: DataFrame, entity_log: DataFrame) -> DataFrame:
    """Docket entries with what their logs say, aggregated per entry before the join."""
    classes = class_log.groupBy(*DOCKET_KEY).agg(
        F.count(F.lit(1)).alias("n_classes"), F.count_if("prediction_value").alias("n_positive"))
    entities = entity_log.groupBy(*DOCKET_KEY).agg(
        F.count("prediction_substring").alias("n_entities"), F.min("prediction_value").alias("first_category"))
    joined = docket.join(classes, DOCKET_KEY, "left").join(entities, DOCKET_KEY, "left")
    return joined.na.fill(0, ["n_classes", "n_positive", "n_entities"])


def entry_children(docket: DataFrame, log: DataFrame) -> DataFrame:
    """Entry ↔ log navigation in long form: one row per pair, entries without log rows kept.

    An inner join and the entries without a match: skew handling may then split
    the log rows of a hot entry, which a left outer join does not allow.
    """
    matched = docket.join(log, DOCKET_KEY)
    return matched.unionByName(without_match(docket, log, DOCKET_KEY), allowMissingColumns=True)


CHILDREN_PER_PART = 1_000


def nested_children(docket: DataFrame, class_log: DataFrame, entity_log: DataFrame,
                    per_part: int = CHILDREN_PER_PART) -> DataFrame:
    """Every entry with its log rows nested in order: ``classes`` and ``entities``, arrays of structs.

    Rows are numbered over all children of an entry's key, classes first, by type and
    value, and packed in parts of ``per_part``: a hot key gives more rows (``part_no``
    from 0), never a longer array. An entry without children has one row with empty
    arrays. Entries that share a key each get its children.
    """
    value = ["prediction_type", "prediction_value", "prediction_substring"]
    classes = class_log.select(*DOCKET_KEY, F.lit(0).alias("kind"), "prediction_type",
                               F.col("prediction_value").cast("string"), F.lit(None).cast("string").alias(value[2]))
    children = classes.unionByName(entity_log.select(*DOCKET_KEY, F.lit(1).alias("kind"), *value)).na.drop(subset=DOCKET_KEY)
    numbered = number_rows(children, DOCKET_KEY, ["kind", *value], "no")
    part = F.floor((F.col("no") - 1) / per_part).alias("part_no")
    packed = numbered.groupBy(*DOCKET_KEY, part).agg(F.array_sort(F.collect_list(F.struct("no", "kind", *value))).alias("rows"))
    joined = docket.join(packed, DOCKET_KEY, "left").withColumn("rows", F.coalesce("rows", F.array().cast(packed.schema["rows"].dataType)))

    def of(kind: int, *fields: str) -> Column:
        return F.transform(F.filter("rows", lambda r: r["kind"] == kind), lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    class_rows = F.transform(of(0, *value[:2]), lambda r: F.struct(
        r[value[0]].alias(value[0]), r[value[1]].cast("boolean").alias(value[1])))
    return joined.select(*docket.columns, F.coalesce("part_no", F.lit(0)).cast("bigint").alias("part_no"),
                         class_rows.alias("classes"), of(1, *value).alias("entities"))
