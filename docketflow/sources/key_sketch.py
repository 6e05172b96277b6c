"""A key sketch beside a log: which of a batch's keys may be in it, and which partitions have to be opened to know.

For every partition of the log there is a Bloom filter over its keys: an array of bits, stored as one row for each word of
64 bits that has any, in a table laid out like the log. A key's partition follows from the key, so a key asks for its own
partition's bits only: HASHES rows a key, joined by partition and word. Keys with a bit missing are new for sure. The
others, real repeats and a few by chance, are looked up in the log itself, of which only their partitions are opened. So
the answer is exact, and its cost follows the batch.

Bits are added before the rows they stand for: a run that stops in between leaves a filter that says "may be" too often,
never too rarely. With WORDS words a partition of 300,000 keys lets 4 in 1,000 new keys through to the log, one of a
million 1 in 7; a partition with a repeat or such a key is opened, as it would be without a sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.operators.select import with_match, without_match
from docketflow.session import remove_path
from docketflow.sources.tables import Table, staged

WORDS = 1 << 16
HASHES = 4
_SCHEMA = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("bits", T.LongType())])


class KeySketch:
    """The sketch of one log; ``keys`` are the columns rows are found by, from which their partition follows."""

    def __init__(self, log: Table, keys: list[str], words: int = WORDS):
        self.log, self.keys, self.words = log, keys, words
        self.table = Table(log.spark, f"{log.name}_sketch", _SCHEMA, {c: f"`{c}`" for c in log.partition_by}).create()

    def _marks(self) -> Column:
        """The bits of a key, as (word, bits) with one bit each."""
        marks = [F.pmod(F.xxhash64(F.lit(i), *self.keys), F.lit(self.words * 64)) for i in range(HASHES)]
        return F.array(*[F.struct(F.floor(m / 64).cast("int").alias("word"),
                                  F.call_function("shiftleft", F.lit(1).cast("long"), (m % 64).cast("int")).alias("bits")) for m in marks])

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Distinct full keys with their partition."""
        return rows.select(*self.keys, *self.log.placement()).na.drop(subset=self.keys).distinct()

    def add(self, rows: DataFrame) -> None:
        """Note the keys of rows that are about to be appended."""
        parts = list(self.log.partition_by)
        marks = self._placed(rows).select(*parts, F.explode(self._marks()).alias("m")) \
            .groupBy(*parts, "m.word").agg(F.bit_or("m.bits").alias("bits"))
        marks.select("word", "bits", *parts).hint("rebalance", *[F.col(c) for c in parts]).write.insertInto(self.table.name)

    def rebuild(self) -> None:
        """Make the sketch anew from the log, for logs that had none, and to join the rows that appends have left."""
        parts = list(self.log.partition_by)
        marks = self._placed(self.log.read()).select(*parts, F.explode(self._marks()).alias("m")) \
            .groupBy(*parts, "m.word").agg(F.bit_or("m.bits").alias("bits"))
        made, path = staged(marks.select("word", "bits", *parts))
        self.table.replace(made, sorted({*self.table.partitions(), *self.table.touched(made)}))
        remove_path(self.log.spark, path)

    def possible(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of the rows that may be in the log, with their partition."""
        parts = list(self.log.partition_by)
        asked = self._placed(rows)
        only = self.table.touched(asked)
        held = self.table.read(only).groupBy(*parts, "word").agg(F.bit_or("bits").alias("held"))
        hits = asked.withColumn("m", F.explode(self._marks())).withColumns({"word": F.col("m.word"), "bit": F.col("m.bits")}) \
            .join(held, [*parts, "word"]).where(F.col("held").bitwiseAND(F.col("bit")) != 0)
        return hits.groupBy(*self.keys, *parts).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES).drop("n")

    def seen(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of the rows that are in the log; opens only partitions that may hold one."""
        maybe, path = staged(self.possible(rows), "possible")
        opened = self.table.touched(maybe)
        found, _ = staged(with_match(maybe.select(*self.keys), self.log.read(opened), self.keys), "seen")
        remove_path(self.log.spark, path)
        return found

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not in the log: what the plain anti-join gives. Rows without a full key count as unseen."""
        return without_match(rows, self.seen(rows), self.keys)
