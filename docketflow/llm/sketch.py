r"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: its lines, and within a line stretches that end at words whose hash is divisible by
``stretch``, so that texts without line ends have paragraphs too, and an edit moves no cut but its own. A paragraph's
digest has 64 bits; one that repeats gets digests of its own for the second, third, .. time, so texts are sets of digests.

A sketch has three tables of cells; every digest is added to one cell of each: count, sum of digests, sum of their check
values. Sums wrap at 64 and 32 bits. Sketches of two versions are subtracted cell by cell, which cancels what both hold.
Peeling takes a cell with one digest left (count 1 or -1, check value right), notes the digest and its side, takes it out
of its other cells, and goes on until all cells are empty. If some stay full, both sides are sketched again with GROW
times the cells. The fingerprint is the first, smallest sketch; the likeness of two texts is 1 - d / (m + n), for m and n
digests of which d are on one side only: 1 for equal texts (two empty ones too), 0 if nothing is shared.

Texts of equal bytes have equal fingerprints. A null text counts as empty: no paragraphs, a sketch of zeros.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from docketflow.llm.rows import by_bytes

TABLES = 3
CELLS = 24
GROW = 4
STRETCH = 4
#: Cells that are peeled at once.
CELLS_AT_ONCE = 1 << 20
MEMO_WORDS = 200_000
#: Texts beyond this many characters are cut into words one by one, not as one list.
LONG_TEXT = 4_000_000
BOUNDS_SAMPLE = 16

_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")
_LINE_END = re.compile("[\n\x0b\x0c\r]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Paragraphs:
    """Paragraph digests of texts; hashes of words that were met are kept, up to MEMO_WORDS."""

    def __init__(self, stretch: int = STRETCH):
        self._stretch, self._known = stretch, {}

    def _hash(self, word: str) -> int:
        """A word's hash; made divisible by the stretch if a line ends here, so that a paragraph ends."""
        value = xxhash.xxh3_64_intdigest(word.encode())
        if _LINE_END.search(word):
            value -= value % self._stretch
        if len(self._known) >= MEMO_WORDS:
            self._known.clear()
        self._known[word] = value
        return value

    def _hashes(self, text: str) -> np.ndarray:
        known, make = self._known, self._hash
        words = _WORD.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in _WORD.finditer(text))
        return np.fromiter((known.get(w) or make(w) for w in words), np.uint64)

    def digests(self, text: str) -> np.ndarray:
        words = self._hashes(text)
        if not len(words):
            return words
        last = words % np.uint64(self._stretch) == 0
        last[-1] = True
        starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        within = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
        found = np.add.reduceat(_mixed(words + _STEP * within.astype(np.uint64)), starts)
        order = np.argsort(found, kind="stable")
        ranked = found[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        at = np.arange(len(ranked))
        times = at - np.maximum.accumulate(np.where(first, at, 0))
        return _mixed(ranked + _STEP * (times + 1).astype(np.uint64))


@dataclass
class Sketches:
    """Sketches of several texts, each of ``cells`` cells, one after the other."""

    cells: int
    count: np.ndarray
    digest: np.ndarray
    check: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray], cells: int) -> Sketches:
        total = len(texts) * cells
        made = cls(cells, np.zeros(total, np.int32), np.zeros(total, np.uint64), np.zeros(total, np.uint32))
        digests = np.concatenate([*texts, np.zeros(0, np.uint64)])
        made._add(digests, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.ones(len(digests), np.int32))
        return made

    def places(self, digests: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The cell of each digest in every table."""
        width = self.cells // TABLES
        return np.stack([owner * self.cells + t * width + (
            _mixed(digests + np.uint64((int(_STEP) * (t + 1) + self.cells) % 2**64)) % np.uint64(width)).astype(np.int64)
            for t in range(TABLES)])

    def _add(self, digests: np.ndarray, owner: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Adds every digest (times 1 or -1) to its cells, and gives these."""
        places = self.places(digests, owner)
        signed, checks = digests * times.astype(np.uint64), _checks(digests) * times.astype(np.uint32)
        for row in places:
            np.add.at(self.count, row, times)
            np.add.at(self.digest, row, signed)
            np.add.at(self.check, row, checks)
        return places

    def __sub__(self, other: Sketches) -> Sketches:
        return Sketches(self.cells, self.count - other.count, self.digest - other.digest, self.check - other.check)

    def to_strings(self) -> list[str]:
        rows = -1, self.cells
        parts = zip(self.count.astype("<i4").reshape(rows), self.digest.astype("<u8").reshape(rows),
                    self.check.astype("<u4").reshape(rows))
        return [base64.b64encode(b"".join(p.tobytes() for p in part)).decode() for part in parts]

    @classmethod
    def from_string(cls, value: str) -> Sketches:
        data = base64.b64decode(value)
        cells = len(data) // 16
        return cls(cells, np.frombuffer(data, "<i4", cells).copy(), np.frombuffer(data, "<u8", cells, 4 * cells).copy(),
                   np.frombuffer(data, "<u4", cells, 12 * cells).copy())

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the sketches: (whether each could be emptied, digests, their sketch, their side: 1 left, -1 right)."""
        found, owners, sides = [], [], []
        cells = np.flatnonzero(self.count)
        while len(cells):
            side = self.count[cells]
            one = np.abs(side) == 1
            cells, side = cells[one], side[one]
            digest = self.digest[cells] * side.astype(np.uint64)
            pure = self.check[cells] == _checks(digest) * side.astype(np.uint32)
            cells, side, digest = cells[pure], side[pure], digest[pure]
            owner = cells // self.cells
            # A digest alone in several cells counts in the first of them.
            places = self.places(digest, owner)
            alone = np.zeros(len(self.count), bool)
            alone[cells] = True
            mine = places[np.argmax(alone[places], axis=0), np.arange(len(cells))] == cells
            digest, owner, side = digest[mine], owner[mine], side[mine]
            if not len(digest) or sum(map(len, found)) > 2 * len(self.count):
                break
            found.append(digest)
            owners.append(owner)
            sides.append(side)
            cells = np.unique(self._add(digest, owner, -side))
        full = (self.count != 0) | (self.digest != 0) | (self.check != 0)
        emptied = ~full.reshape(-1, self.cells).any(axis=1)
        none = np.zeros(0, np.int64)
        return (emptied, np.concatenate([*found, none.astype(np.uint64)]), np.concatenate([*owners, none]),
                np.concatenate([*sides, none]))


def _checks(digests: np.ndarray) -> np.ndarray:
    return (_mixed(digests ^ _STEP) >> np.uint64(32)).astype(np.uint32)


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets what only the left and only the right one holds, by subtracting and peeling.

    Sketches that cannot be emptied are retried with GROW times the cells. A pair that fails with 64 cells a digest (which
    needs digests that agree in all hashes) is compared directly.
    """
    out: list = [None] * len(left)
    pending = list(range(len(left)))
    while pending:
        failed = []
        step = max(1, CELLS_AT_ONCE // cells)
        for at in range(0, len(pending), step):
            some = pending[at:at + step]
            rest = Sketches.of([left[i] for i in some], cells) - Sketches.of([right[i] for i in some], cells)
            emptied, digests, owner, side = rest.peel()
            order = np.argsort(owner, kind="stable")
            digests, side = digests[order], side[order]
            ends = np.cumsum(np.bincount(owner, minlength=len(some)))
            for j, i in enumerate(some):
                if emptied[j]:
                    mine = slice(ends[j - 1] if j else 0, ends[j])
                    out[i] = digests[mine][side[mine] > 0], digests[mine][side[mine] < 0]
                elif cells > 64 * (len(left[i]) + len(right[i])) + 1024:
                    out[i] = np.setdiff1d(left[i], right[i]), np.setdiff1d(right[i], left[i])
                else:
                    failed.append(i)
        pending, cells = failed, cells * GROW
    return out


def likeness(left: np.ndarray, right: np.ndarray, difference: tuple[np.ndarray, np.ndarray]) -> float:
    total = len(left) + len(right)
    return 1 - sum(map(len, difference)) / total if total else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", cells: int = CELLS, stretch: int = STRETCH) -> DataFrame:
    """key, fingerprint, n_paragraphs of every row."""
    def work(paragraphs: Paragraphs, columns: list[list]) -> list[list]:
        found = [paragraphs.digests(t or "") for t in columns[1]]
        return [columns[0], Sketches.of(found, cells).to_strings(), list(map(len, found))]

    schema = StructType([docs.select(key).schema[0], *StructType.fromDDL("fingerprint string, n_paragraphs long").fields])
    return _mapped(docs.select(key, text), work, schema, stretch)


def compare(pairs: DataFrame, left: str, right: str, cells: int = CELLS, stretch: int = STRETCH) -> DataFrame:
    """All columns, with ``likeness`` and the digests of paragraphs that only one text holds: ``only_left``, ``only_right``.

    Columns of these names are replaced.
    """
    made = StructType.fromDDL("likeness double, only_left array<long>, only_right array<long>")
    others = [c for c in pairs.columns if c not in made.names]
    given = pairs.select(F.struct(*others).alias("row"), F.col(left).alias("a"), F.col(right).alias("b"))

    def work(paragraphs: Paragraphs, columns: list[list]) -> list[list]:
        a, b = ([paragraphs.digests(t or "") for t in column] for column in columns[1:])
        found = differences(a, b, cells)
        return [columns[0], [likeness(*x) for x in zip(a, b, found)], *[[d[side].view(np.int64).tolist() for d in found] for side in (0, 1)]]

    return _mapped(given, work, StructType([given.schema[0], *made.fields]), stretch).select("row.*", *made.names)


def _mapped(df: DataFrame, work, schema: StructType, stretch: int) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paragraphs = Paragraphs(stretch)
        for part in by_bytes(batches):
            columns = work(paragraphs, [c.to_pylist() for c in part.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def dealt_in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, edge, key, text: stretches of the order by key, one to a task, each with the row behind it as its ``edge``.

    Rows are ordered by key (null first), equal keys by the hash of their text; the row behind the last is the first.
    Bounds are chosen from a sample of keys, as many as there are shuffle partitions; where they lie changes no result.
    The first rows of the stretches, one each, are found by an aggregation and sent along with the stretch before.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(F.col(key).isNotNull().alias("has"), F.col(key).alias("id"), F.xxhash64(text).alias("mark"))
    kind = docs.schema[key].dataType
    keys = docs.select(place.alias("place"))
    sample = sorted((r["place"] for r in keys.orderBy(F.rand(7)).limit(BOUNDS_SAMPLE * parts).collect()),
                    key=lambda p: (p["has"], p["id"] if p["has"] else 0, p["mark"]))
    bounds = list(dict.fromkeys(sample[i * len(sample) // parts] for i in range(1, parts))) if sample else []
    part = _stretch(F.col("place"), [F.struct(F.lit(b["has"]).alias("has"), F.lit(b["id"]).cast(kind).alias("id"), F.lit(b["mark"]).alias("mark"))
                                     for b in bounds])
    firsts = keys.select(part.alias("part"), "place").groupBy("part").agg(F.min("place").alias("place")).orderBy("part").collect()
    rows = docs.select(place.alias("place"), F.col(key).alias("key"), F.col(text).alias("text"))
    edges = [(firsts[i - 1]["part"], f["place"]["has"], f["place"]["id"], f["place"]["mark"]) for i, f in enumerate(firsts)]
    schema = StructType.fromDDL("part int, e_has boolean, e_mark long")
    listed = spark.createDataFrame(edges, StructType([schema[0], schema[1], StructField("e_id", kind), schema[2]]))
    # At most one row for each shuffle partition, hence small.
    behind = rows.join(F.broadcast(listed), (F.col("place.mark") == F.col("e_mark")) & F.col("place.id").eqNullSafe(F.col("e_id"))) \
        .dropDuplicates(["part"]).select("part", F.lit(True).alias("edge"), "place", "key", "text")
    every = rows.select(part.alias("part"), F.lit(False).alias("edge"), "place", "key", "text").union(behind)
    return every.repartitionById(parts, "part").sortWithinPartitions("part", "edge", "place").select("part", "edge", "key", "text")


def _stretch(place: Column, bounds: list[Column]) -> Column:
    """How many of the ascending bounds are not above a place, by binary search."""
    if not bounds:
        return F.lit(0)
    table, steps = F.array(*bounds), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(table, at + step - 1) <= place), at + step).otherwise(at))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the following one."""
    size = len(text) // 4
    return text[:len(text) - size] + following[:size]


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text", cells: int = CELLS, stretch: int = STRETCH) -> DataFrame:
    """Every row against its edited text and the next row, in the order of :func:`dealt_in_order`.

    key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs. Repeated rows
    follow one another; of a table of one row the next is the row itself; an empty table stays one.
    """
    made = StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                              "near_edited double, near_next double, n_paragraphs long")
    schema = StructType([docs.select(key).schema[0], *made.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paragraphs = Paragraphs(stretch)
        carried: list[tuple] = []
        for batch in by_bytes(batches, 3):
            rows = carried + [(p, e, k, t or "", paragraphs.digests(t or ""))
                              for p, e, k, t in zip(*(c.to_pylist() for c in batch.columns))]
            carried = rows[-1:]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0]]
            if not pairs:
                continue
            texts = [edited(a[3], b[3]) for a, b in pairs]
            own, following, changed = [a[4] for a, _ in pairs], [b[4] for _, b in pairs], [paragraphs.digests(t) for t in texts]
            near = [[likeness(*x) for x in zip(own, other, differences(own, other, cells))] for other in (changed, following)]
            columns = [[a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in texts],
                       Sketches.of(own, cells).to_strings(), Sketches.of(changed, cells).to_strings(), *near, list(map(len, own))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return dealt_in_order(docs.select(key, text), key, text).mapInArrow(run, schema)
