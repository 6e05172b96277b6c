"""Catalog tables that are written partition by partition.

The docket and its logs share one layout: the month of the publication time.
Logs keyed by an address are laid out by the first digit of the address's hash.
Rows are staged in the shared folder before a table is touched, so a table is
never read and overwritten by the same plan and a lost executor repeats nothing.

Replacing partitions writes a new version of them beside the old one, notes in a small intent file which partitions
belong to it, and then points the catalog there. A run that stops in between is completed by whoever opens the table
next, so readers of this library never meet rows of both states. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow import schemas
from docketflow.session import file_names, read_text, remove_path, scratch_path, write_text

NO_VALUE = "none"
_VERSIONS = "_versions"
_INTENT = "_intent.json"


def staged(rows: DataFrame, label: str = "staged") -> tuple[DataFrame, str]:
    """The rows, written to the shared folder and read back, and their path."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


class Table:
    """One partitioned table; ``partition_by`` maps its partition columns to the SQL expressions they follow from."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType, partition_by: dict[str, str],
                 keys: list[str] | None = None):
        self.spark, self.name, self.schema, self.partition_by, self.keys = spark, name, schema, partition_by, keys
        self._location: str | None = None

    def create(self) -> Table:
        columns = [*schemas.ddl(self.schema), *[f"`{c}` string" for c in self.partition_by]]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({', '.join(columns)}) USING parquet "
                       f"PARTITIONED BY ({', '.join(f'`{c}`' for c in self.partition_by)})")
        return self

    def location(self) -> str:
        if self._location is None:
            shown = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Location'")
            self._location = shown.first()["data_type"].rstrip("/")
        return self._location

    def partitions(self) -> list[tuple[str, ...]]:
        """Values of the partition columns of every partition."""
        self.recover()
        return self._listed()

    def _listed(self) -> list[tuple[str, ...]]:
        shown = self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()
        return sorted(tuple(part.split("=", 1)[1] for part in r[0].split("/")) for r in shown)

    def read(self, only: list[tuple[str, ...]] | None = None) -> DataFrame:
        """All rows, or those of the named partitions; other partitions are not opened."""
        self.recover()
        self.spark.catalog.refreshTable(self.name)
        rows = self.spark.table(self.name)
        return rows if only is None else rows.where(self._in(only))

    def _in(self, only: list[tuple[str, ...]]) -> Column:
        """Row belongs to one of the partitions: for each first value a list of the last ones."""
        *outer, last = self.partition_by
        found: dict[tuple[str, ...], list[str]] = {}
        for values in only:
            found.setdefault(values[:-1], []).append(values[-1])
        hit = F.lit(False)
        for values, inner in found.items():
            one = F.col(last).isin(inner)
            for column, value in zip(outer, values):
                one = one & (F.col(column) == value)
            hit = hit | one
        return hit

    def placement(self) -> list[Column]:
        """The partition columns, as they follow from a row."""
        return [F.coalesce(F.expr(e).cast("string"), F.lit(NO_VALUE)).alias(c) for c, e in self.partition_by.items()]

    def placed(self, rows: DataFrame) -> DataFrame:
        """The table's columns, with the partition each row belongs to."""
        return rows.select(*self.schema.names, *self.placement())

    def partitions_of(self, rows: DataFrame) -> list[tuple[str, ...]]:
        """Partitions the rows belong to; they need only the columns these follow from."""
        return self.touched(rows.select(*self.placement()))

    def touched(self, placed: DataFrame) -> list[tuple[str, ...]]:
        """Partitions that hold any of the rows: at most one for each row of a batch, and for each partition there is."""
        return sorted(tuple(r) for r in placed.select(*self.partition_by).distinct().collect())

    def replace(self, rows: DataFrame, touched: list[tuple[str, ...]]) -> None:
        """Make ``rows`` the content of the touched partitions; those without rows leave the table.

        All rows have to belong to touched partitions. The rebalance splits a hot
        partition over several files and keeps small ones whole.
        """
        self.recover()
        version = f"{self.location()}/{_VERSIONS}/{uuid.uuid4().hex}"
        self.placed(rows).hint("rebalance", *[F.col(c) for c in self.partition_by]) \
            .write.partitionBy(*self.partition_by).parquet(version)
        written = self._in_folder(version)
        if stray := set(written) - set(touched):
            remove_path(self.spark, version)
            raise ValueError(f"rows of partitions that are not replaced: {sorted(stray)[:5]}")
        intent = {"version": version, "written": written, "emptied": sorted(set(touched) - set(written))}
        write_text(self.spark, f"{self.location()}/{_INTENT}", json.dumps(intent))
        self._switch(intent)

    def recover(self) -> None:
        """Complete a replacement that stopped between its intent and its end."""
        if (intent := read_text(self.spark, f"{self.location()}/{_INTENT}")) is not None:
            self._switch(json.loads(intent))

    def _switch(self, intent: dict) -> None:
        """Point the catalog to a version, drop what it emptied, then remove older versions. May be repeated."""
        version, held = intent["version"], set(self._listed())
        new = []
        for values in map(tuple, intent["written"]):
            place = f"{self._spec(values)} {{}} '{version}/{self._folder(values)}'"
            if values in held:
                self.spark.sql(f"ALTER TABLE {self.name} {place.format('SET LOCATION')}")
            else:
                new.append(place.format("LOCATION"))
        if new:
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {' '.join(new)}")
        gone = [self._spec(v) for v in map(tuple, intent["emptied"]) if v in held]
        if gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {', '.join(gone)}")
        self.spark.catalog.refreshTable(self.name)
        root = self.location()
        replaced = set(map(tuple, intent["written"] + intent["emptied"]))
        for values in replaced.intersection(self._in_folder(root)):
            remove_path(self.spark, f"{root}/{self._folder(values)}")
        for name in file_names(self.spark, f"{root}/{_VERSIONS}"):
            if (other := f"{root}/{_VERSIONS}/{name}") != version:
                self._remove_replaced(other, replaced)
        remove_path(self.spark, f"{root}/{_INTENT}")

    def _remove_replaced(self, version: str, replaced: set[tuple[str, ...]]) -> None:
        """Remove the replaced partitions of an older version; one that holds nothing else goes as a whole."""
        here = set(self._in_folder(version))
        if here <= replaced:
            remove_path(self.spark, version)
        else:
            for values in here & replaced:
                remove_path(self.spark, f"{version}/{self._folder(values)}")

    def _spec(self, values: tuple[str, ...]) -> str:
        return "PARTITION (" + ", ".join(f"`{c}` = '{v}'" for c, v in zip(self.partition_by, values)) + ")"

    def _folder(self, values: tuple[str, ...]) -> str:
        return "/".join(f"{c}={v}" for c, v in zip(self.partition_by, values))

    def _in_folder(self, path: str, depth: int = 0) -> list[tuple[str, ...]]:
        """Partitions below a folder that was just written."""
        if depth == len(self.partition_by):
            return [()]
        names = [n for n in file_names(self.spark, path) if "=" in n]
        return [(n.split("=", 1)[1], *rest) for n in names for rest in self._in_folder(f"{path}/{n}", depth + 1)]

    def sketch(self):
        """The key sketch of this log; made from its rows, if it had none. From then on appends keep it."""
        from docketflow.sources.key_sketch import KeySketch
        is_new = not self._has_sketch()
        made = KeySketch(self, self.keys)
        if is_new and self.partitions():
            made.rebuild()
        return made

    def _has_sketch(self) -> bool:
        return self.keys is not None and self.spark.catalog.tableExists(f"{self.name}_sketch")

    def append(self, rows: DataFrame, key: str) -> None:
        """Add the rows whose ``key`` is not there yet.

        What a run adds depends on the table alone, so replays add nothing and runs
        with new checkpoints destroy nothing. Only partitions of the rows are read;
        of a log with a key sketch only those that may hold one of them.
        """
        if self._has_sketch():
            self._append_with_sketch(rows, key)
            return
        # One plan: what is left of each key meets the log's keys where it was shuffled to, and nothing is stored between.
        held = self.partitions()
        opened = [p for p in self.partitions_of(rows) if p in set(held)] if held else []
        new = self.placed(rows.dropDuplicates([key]))
        fresh = new.join(self.read(opened).select(key), key, "left_anti") if opened else new
        fresh.select(*new.columns).write.insertInto(self.name)

    def _append_with_sketch(self, rows: DataFrame, key: str) -> None:
        sketch = self.sketch()
        new, path = staged(self.placed(rows.dropDuplicates([key])))
        opened = self.touched(sketch.possible(new))
        fresh = new.join(self.read(opened).select(key), key, "left_anti").select(*new.columns)
        sketch.add(fresh)
        fresh.write.insertInto(self.name)
        remove_path(self.spark, path)


class Warehouse:
    """The library's tables in one database below ``location``.

    With ``parts`` above 1 every month (or hash digit) is split further by a hash of
    the key. A small batch then rewrites little of a large month.
    """

    def __init__(self, spark: SparkSession, database: str, location: str, parts: int = 1):
        self.spark, self.database, self.parts = spark, database, parts
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")

    def table(self, name: str) -> Table:
        schema, key, partition_by = schemas.TABLES[name]
        if self.parts > 1:
            partition_by = {**partition_by, "key_part": f"pmod(xxhash64({', '.join(key)}), {self.parts})"}
        return Table(self.spark, f"{self.database}.{name}", schema, partition_by, key).create()

    def tables(self) -> dict[str, Table]:
        return {name: self.table(name) for name in schemas.TABLES}
