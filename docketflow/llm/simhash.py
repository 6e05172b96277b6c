r"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints that differ in at most d bits have a value in common that is at most d/2 bits away from either, so it
is enough that every distinct fingerprint emits its ball of radius d/2 and that equal values meet in a shuffle. For odd
d the halves would be unequal (1 and 2 bits for d = 3, that is 2,081 values on one side). Instead one block of bits is
hidden: of the differing bits at least one lies in some block of a partition of the 64 bits, so with that block hidden at
most d - 1 differ, and balls of radius (d - 1) / 2 on the visible bits meet. With three blocks and d = 3 that is some 130
values for each distinct fingerprint, and no pair is missed.

Rows that meet are verified on all 64 bits. Within a bucket only a spanning forest of the verified links is emitted, one
link for each member at most, never all pairs. Equal fingerprints are one node from the start, so groups of copies cost
nothing; components follow in `components`.

A null text is an empty one: no shingle, fingerprint zero. Fewer words than a shingle count as one shingle of all words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.components import components
from docketflow.llm.rows import map_rows
from docketflow.session import cut_lineage

BITS = 64
SHINGLE = 3
MAX_BITS = 3
SEED = 42
HIDDEN_BLOCKS = 3
#: Above this size the links inside a bucket are found by looking up neighbours and not by comparing members.
COMPARE_ALL = 2_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half the shingle hashes (XXH64 of the space-joined words)."""
    words = _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
    if not words:
        return 0
    plain = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(words))
    begins, stops = (ends - sizes)[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(plain[a:b], SEED) for a, b in zip(begins, stops)), np.uint64, len(begins))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``fp`` (the fingerprint as a signed 64-bit number) of every row."""
    return map_rows(docs.select(key, text), lambda t: (int(np.uint64(fingerprint(t, shingle)).astype(np.int64)),),
                    "fp long", keep=True)


def hidden_masks(max_bits: int, blocks: int = HIDDEN_BLOCKS) -> list[int]:
    """The bits hidden in turn: none for an even distance, a partition of all bits for an odd one."""
    if max_bits % 2 == 0:
        return [0]
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).astype(np.int64)


def ball(mask: int, radius: int) -> list[int]:
    """All values with at most ``radius`` bits set, none of them hidden."""
    bits = [1 << i for i in range(BITS) if not mask >> i & 1]
    shells = [{0}]
    for _ in range(radius):
        shells.append({x | b for x in shells[-1] for b in bits if not x & b})
    return sorted(set().union(*shells))


def _variants(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(place, value, fp): every value in the ball of every distinct fingerprint, for every hidden block."""
    radius = max_bits // 2
    tables = [(i, int(_signed([~m & (1 << BITS) - 1])[0]), _signed(ball(m, radius))) for i, m in enumerate(hidden_masks(max_bits))]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 1_000):
                part = fps[at:at + 1_000]
                for place, visible, flips in tables:
                    values = ((part & visible)[:, None] ^ flips).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), place, np.int8)), pa.array(values),
                                                      pa.array(np.repeat(part, len(flips)))], names=["place", "value", "fp"])

    # Eight bytes a fingerprint look small to the planner, which would leave the work to a few tasks. The nodes come
    # grouped by fingerprint; dealing them out by the fingerprint again would be left out as needless.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.select("fp").repartition(tasks, F.xxhash64("fp")).mapInArrow(emit, "place byte, value long, fp long")


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one bucket."""
    n = len(fps)
    if n == 2:
        return [(int(fps[0]), int(fps[1]))] if int(fps[0] ^ fps[1]).bit_count() <= max_bits else []
    values = fps.view(np.uint64)
    left, out = np.arange(n), []
    at = {int(v): i for i, v in enumerate(values)} if n > COMPARE_ALL else {}
    flips = ball(0, max_bits) if at else []
    waiting: list[int] = []
    unseen = np.ones(n, bool)
    while True:
        if not waiting:
            left = left[unseen[left]]
            if not len(left):
                return out
            waiting, unseen[left[0]] = [int(left[0])], False
        node = waiting.pop()
        if at and len(left) > len(flips):
            near = [j for x in flips if (j := at.get(int(values[node]) ^ x)) is not None and unseen[j]]
        else:
            left = left[unseen[left]]
            near = left[np.bitwise_count(values[left] ^ values[node]) <= max_bits].tolist()
        for j in near:
            unseen[j] = False
            out.append((int(fps[node]), int(fps[j])))
        waiting += near


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): enough of the links between distinct fingerprints to connect all that are linked."""
    met = _variants(nodes, max_bits).repartition("place", "value").sortWithinPartitions("place", "value")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []   # batches that may all belong to one bucket

        def work(place, value, fp):
            starts = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (place[1:] != place[:-1])]))
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            two = starts[sizes == 2]
            close = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= max_bits
            found = list(zip(fp[two][close].tolist(), fp[two + 1][close].tolist()))
            for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found += _forest(fp[s:s + size], max_bits)
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def joined():
            return (np.concatenate(x) for x in zip(*kept))

        for batch in batches:
            place, value, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fp):
                continue
            if kept and (kept[-1][0][-1], kept[-1][1][-1]) != (place[0], value[0]):
                yield work(*joined())
                kept = []
            changed = np.flatnonzero((value[1:] != value[:-1]) | (place[1:] != place[:-1]))
            cut = int(changed[-1]) + 1 if len(changed) else 0
            if cut:
                kept.append([place[:cut], value[:cut], fp[:cut]])
                yield work(*joined())
                kept = []
            kept.append([place[cut:], value[cut:], fp[cut:]])
        if kept:
            yield work(*joined())

    return met.mapInArrow(runs, "a long, b long")


def groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """key, fp, component (smallest key reachable) of every row.

    Fingerprints are computed once and kept in the shared folder. A component whose keys are all null has component null.
    """
    marked = cut_lineage(fingerprints(docs, shingle, key, text))
    nodes = marked.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(nodes, max_bits))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return marked.join(rooted.join(least, "root").select("fp", "component"), "fp").select(key, "fp", "component")
