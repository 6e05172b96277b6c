"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of ``length`` bytes (a window) that starts at another place too, in another text or
the same one; matches never cross texts and all windows are judged on the input. Steps, over all rows:

1. `marks` (one pass): every window has a minimum among the hashes of its ``gram``-byte strings. Neighbouring windows
   with the same minimum form a segment, one in some 200 bytes. Equal windows have equal minima, so a window can repeat
   only where the minimum's gram was met twice. All other segments are done: this spares most of a corpus the sorting.
2. Equal texts are one text from here on: each of its windows repeats in its copies. `touched`: texts with segments left.
3. `contents`: the bytes of these segments, equal ones combined within tasks before the shuffle, go to shards by minimum.
   A minimum with more than SHARD_BYTES of distinct bytes (a passage that very many texts share) is split by content.
4. `repeated`: every shard builds a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's
   recurrence, both in numpy, the latter for all segments in step. A window repeats if its common prefix with a
   neighbour in suffix order has ``length`` bytes, or if its segment was met twice.
5. `merged`: the parts of a split minimum send the sorted digests of their distinct windows, cut into ranges; each range
   is merged by binary search over the parts, so none of the tasks sees the whole group.
6. The ranges found go back to their texts, where the bytes are removed.

Null texts are empty. Rows are matched by content, so ids may be null or repeat. Texts shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.rows import slices
from docketflow.session import scratch_path

LENGTH = 400
GRAM = 32
#: Bytes sorted at once; below 2^21 a rank pair and a place fit one 64-bit number.
CHUNK_BYTES = 1_900_000
SHARD_BYTES = 300_000
#: Ranges that the digests of a split minimum are dealt to, for each of its parts.
PIECES = 8
#: Parts up to which that holds; beyond them a part more gives a quarter of a range.
MANY_PARTS = 64
#: Suffixes of a segment that are compared one after the other.
STRETCH = 64

_RNG = np.random.default_rng(5)
_TABLE = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes, by doubling."""
    n = len(data) - width + 1
    power, size, level, have, made = _TABLE[family][data], 1, 0, 0, None
    while True:
        if width & size:
            part = power[have:have + n]
            made = part if made is None else made * _FACTORS[family][32 + level] + part
            have += size
        if 2 * size > width:
            break
        power = power[:-size] * _FACTORS[family][level] + power[size:]
        size, level = 2 * size, level + 1
    made = made ^ (made >> np.uint64(29))
    made = made * _FACTORS[family][63]
    return made ^ (made >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, low, n = 1, values, len(values) - width + 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return low[:n] if size == width else np.minimum(low[:n], low[width - size:width - size + n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimum: first window, windows, minimum, and how often its gram occurs (1 or 2 and more)."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int32, np.int32, np.int64, np.int32))
    hashes = _hashes(np.frombuffer(data, np.uint8), gram)
    width = length - gram + 1
    low = _sliding_min(hashes, width)
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(low)]]))
    minima = low[starts]
    # Where each minimum's gram occurs in the reach of its segment: only positions that are some segment's minimum count.
    held = np.flatnonzero(np.isin(hashes, np.unique(minima)))
    at = np.searchsorted(held, starts)
    seen = np.zeros(len(starts), np.int32)
    open_ = np.arange(len(starts))
    while len(open_):
        inside = at[open_] < len(held)
        open_ = open_[inside]
        place = held[at[open_]]
        near = place < starts[open_] + sizes[open_] + width - 1
        open_, place = open_[near], place[near]
        seen[open_] += hashes[place] == minima[open_]
        at[open_] += 1
        open_ = open_[seen[open_] < 2]
    return starts.astype(np.int32), sizes.astype(np.int32), minima.view(np.int64), np.minimum(seen, 2)


def suffix_order(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's place; a suffix stops at its segment's end, ``ends``.

    Larsson-Sadakane: suffixes are sorted by their first symbols, then groups that still tie are sorted by the ranks their
    members have further on, which doubles the depth each round; single members are never touched again. Equal suffixes of
    different segments stay in the order of their places.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    place = np.arange(n, dtype=np.uint64)
    symbols, key = text.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    depth = 4
    for k in range(depth):
        ahead = np.zeros(n, np.uint64)
        ahead[:n - k] = symbols[k:]
        ahead[place.astype(np.int64) + k >= ends] = 0
        key = key << np.uint64(9) | ahead
    if 36 + bits <= 64:
        packed = np.sort(key << np.uint64(bits) | place)
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        head = np.concatenate([[True], (packed[1:] >> np.uint64(bits)) != (packed[:-1] >> np.uint64(bits))])
    else:
        order = np.argsort(key, kind="stable")
        head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0)) + 1
    single = head & np.concatenate([head[1:], [True]])
    slots = slots[~single]
    while len(slots):
        members = order[slots]
        first = rank[members]
        reach = members + depth
        second = np.where(reach < ends[members], rank[np.minimum(reach, n - 1)], 0)
        if 3 * bits <= 64:
            packed = np.sort(first.astype(np.uint64) << np.uint64(2 * bits) | second.astype(np.uint64) << np.uint64(bits)
                             | np.arange(len(slots), dtype=np.uint64))
            turn = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
            pair = packed >> np.uint64(bits)
        else:
            turn = np.lexsort((second, first))
            pair = first[turn].astype(np.uint64) << np.uint64(32) | second[turn].astype(np.uint64)
        members, second = members[turn], second[turn]
        order[slots] = members
        head = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[members] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))] + 1
        done = (head & np.concatenate([head[1:], [True]])) | (second == 0)
        slots, depth = slots[~done], 2 * depth
    rank[order] = np.arange(n)
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, counts: np.ndarray,
                    ends: np.ndarray, limit: int) -> np.ndarray:
    """Bytes, up to ``limit``, that the first ``counts`` suffixes of each segment share with the one before them in order.

    Kasai's recurrence: what suffix i shares with its neighbour, suffix i + 1 shares with its own but for one byte. All
    segments take this walk in step, eight bytes at a time, and start anew every STRETCH suffixes, so that one very long
    segment does not make the walk long. Other suffixes get 0.
    """
    n = len(text)
    words = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(8):
        words |= padded[k:k + n] << np.uint64(8 * k)
    pieces = -(-counts // STRETCH)
    first = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sizes = np.minimum(np.repeat(counts, pieces) - first * STRETCH, STRETCH)
    starts = np.repeat(starts, pieces) + first * STRETCH
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    stops = ends[starts]
    shared = np.zeros(n, np.int32)
    have = np.zeros(len(starts), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        count = len(sizes) - int(np.searchsorted(sizes[::-1], t, side="right"))
        here = starts[:count] + t
        place = rank[here]
        before = order[np.maximum(place - 1, 0)]
        most = np.minimum(np.minimum(stops[:count] - here, ends[before] - before), limit)
        most[place == 0] = 0
        have = np.minimum(np.maximum(have[:count] - 1, 0), most)
        todo = np.flatnonzero(have < most)
        while len(todo):
            h, top = have[todo], most[todo]
            differ = words[here[todo] + h] ^ words[before[todo] + h]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3   # 8 where nothing differs
            have[todo] = np.minimum(h + same, top)
            todo = todo[(same == 8) & (h + 8 < top)]
        shared[here] = have
    return shared


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its windows occur at another place in any of the parts."""
    sizes = np.array([len(p) for p in parts])
    stops = np.cumsum(sizes)
    text = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.repeat(stops, sizes)
    order, rank = suffix_order(text, ends)
    shared = common_prefixes(text, order, rank, stops - sizes, np.maximum(sizes - length + 1, 0), ends, length)
    equal = shared >= length
    equal[order[:-1]] |= shared[order[1:]] >= length
    return [equal[b - s:b - length + 1] for s, b in zip(sizes, stops)]


def _ranges(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes that flagged windows cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(at, cut)]


def marks(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """key, tid (SHA-256 of the text), n_bytes and the segments of every row."""
    kind = dict(docs.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            data = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            made = [segments(d, length, gram) for d in data]
            lists = [pa.array([m[i] for m in made], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.sha256(d).hexdigest() for d in data]), pa.array([len(d) for d in data], pa.int64()),
                 *lists], names=[key, "tid", "n_bytes", "at", "n", "low", "seen"])

    return docs.select(key, text).mapInArrow(
        work, f"{key} {kind}, tid string, n_bytes long, at array<int>, n array<int>, low array<bigint>, seen array<int>")


def touched(docs: DataFrame, marked: DataFrame, text: str) -> DataFrame:
    """tid, text and remaining segments of the texts that may hold a repeated window."""
    each = marked.where(F.size("at") > 0).select("tid", "at", "n", "low", "seen").dropDuplicates(["tid"]) \
        .select("tid", F.explode(F.arrays_zip("at", "n", "low", "seen")).alias("s")).select("tid", "s.*")
    often = each.groupBy("low").agg(F.sum("seen").alias("seen")).where(F.col("seen") > 1).select("low")
    left = each.join(often, "low", "left_semi").groupBy("tid").agg(F.collect_list(F.struct("at", "n", "low")).alias("segments"))
    texts = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("tid"), F.col(text).alias("text")).dropDuplicates(["tid"])
    return texts.join(left, "tid")


def _cut(texts: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    """Segments as (low, sid, bytes or place); with bytes, equal ones within a batch are combined and counted."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found: dict[tuple[int, bytes], list] = {}
            rows = []
            for tid, text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "replace")
                for s in cuts:
                    part = data[s["at"]:s["at"] + s["n"] + length - 1]
                    sid = hashlib.md5(part).digest()
                    if with_bytes:
                        found.setdefault((s["low"], sid), [0, part])[0] += 1
                    else:
                        rows.append((s["low"], sid, tid, s["at"], len(part)))
            if with_bytes:
                rows = [(*k, *v) for k, v in found.items()]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary()) if with_bytes else \
                (pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int32())
            names = ["low", "sid", "copies", "bytes"] if with_bytes else ["low", "sid", "tid", "at", "size"]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "low long, sid binary, copies int, bytes binary" if with_bytes else "low long, sid binary, tid string, at int, size int"
    return texts.select("tid", "text", "segments").mapInArrow(work, schema)


def _groups(batches: Iterator[pa.RecordBatch], chunk: int):
    """Lists of (low, part, sid, copies, bytes) from sorted rows, equal ones merged, cut between groups at ``chunk`` bytes."""
    held: list[list] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][0] == row[0] and held[-1][2] == row[2]:
                held[-1][3] += row[3]
                continue
            if size >= chunk and (held[-1][0], held[-1][1]) != (row[0], row[1]):
                yield held
                held, size = [], 0
            held.append(list(row))
            size += len(row[4])
    if held:
        yield held


_RANGES = "sid binary, ranges array<struct<a:int,b:int>>"


def _range_batch(rows: list[tuple[bytes, list[tuple[int, int]]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()),
                                       pa.array([[{"a": a, "b": b} for a, b in r[1]] for r in rows], kind)], names=["sid", "ranges"])


def repeated(shards: DataFrame, length: int, chunk: int) -> DataFrame:
    """sid and the byte ranges of its segment that windows repeated within the shard cover."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, chunk):
            members = Counter((row[0], row[1]) for row in held)
            # A segment that was met twice and meets no other one has nothing left to find.
            alone = [row for row in held if row[3] > 1 and members[row[0], row[1]] == 1]
            others = [row for row in held if row[3] == 1 or members[row[0], row[1]] > 1]
            flags = repeated_windows([row[4] for row in others], length) if others else []
            found = [(row[2], [(0, len(row[4]))]) for row in alone]
            found += [(row[2], [(0, len(row[4]))] if row[3] > 1 else _ranges(f, length)) for row, f in zip(others, flags)]
            yield _range_batch([x for x in found if x[1]])

    return shards.mapInArrow(work, _RANGES)


def ranges_of(parts: int) -> int:
    """Ranges in which the windows of a minimum of so many parts meet: several a part, then fewer, so rows don't grow as fast."""
    return min(PIECES * parts, PIECES * MANY_PARTS + parts // 4)


def merged(shards: DataFrame, length: int, chunk: int) -> DataFrame:
    """The ranges that windows repeated in another part of a split minimum cover."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, chunk):
            rows = []
            for (low, part), members in groupby(held, key=lambda row: (row[0], row[1])):
                members = list(members)
                texts = [np.frombuffer(row[4], np.uint8) for row in members]
                made = [(_hashes(t, length), _hashes(t, length, 1)) for t in texts]
                value, check = (np.concatenate(x) for x in zip(*made))
                sizes = [len(v) for v, _ in made]
                at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                owner = np.repeat(np.arange(len(members), dtype=np.int32), sizes)
                piece = (value % np.uint64(ranges_of(members[0][5]))).astype(np.int64)
                order = np.argsort(piece, kind="stable")
                for one in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
                    owners, of = np.unique(owner[one], return_inverse=True)
                    rows.append((low, int(piece[one[0]]), part, [members[i][2] for i in owners], of.astype("<i4").tobytes(),
                                 value[one].tobytes(), check[one].tobytes(), at[one].astype("<i4").tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), *[pa.binary()] * 4)
            names = ["low", "piece", "part", "sids", "owner", "value", "check", "at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        sids = [sid for held in group["sids"] for sid in held]
        before = np.cumsum([0, *[len(held) for held in group["sids"]]])[:-1]
        own = [np.frombuffer(x, np.uint64) for x in group["value"]]
        sizes = [len(x) for x in own]
        value, check = np.concatenate(own), np.concatenate([np.frombuffer(x, np.uint64) for x in group["check"]])
        at = np.concatenate([np.frombuffer(x, "<i4") for x in group["at"]])
        owner = np.concatenate([np.frombuffer(x, "<i4") + n for x, n in zip(group["owner"], before)])
        part = np.repeat(group["part"].to_numpy(), sizes)
        # Each window is looked up once among the windows of all parts; those that meet others are compared by their check.
        everything = np.sort(value)
        met = np.searchsorted(everything, value, side="right") - np.searchsorted(everything, value) > 1
        some = np.flatnonzero(met)
        some = some[np.lexsort((part[some], check[some], value[some]))]
        hit = np.zeros(len(value), bool)
        if len(some):
            v, c, p = value[some], check[some], part[some]
            starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])]))
            ends = np.append(starts[1:], len(some))
            hit[some] = np.repeat(p[starts] != p[ends - 1], ends - starts)
        found = np.flatnonzero(hit)
        found = found[np.lexsort((at[found], owner[found]))]
        out = []
        for run in np.split(found, np.flatnonzero(np.diff(owner[found])) + 1) if len(found) else []:
            flags = np.zeros(int(at[run[-1]]) + 1, bool)
            flags[at[run]] = True
            out.append((sids[owner[run[0]]], [{"a": a, "b": b} for a, b in _ranges(flags, length)]))
        return pd.DataFrame(out, columns=["sid", "ranges"])

    rows = shards.mapInArrow(digest, "low long, piece int, part int, sids array<binary>, owner binary, value binary, "
                             "check binary, at binary")
    return rows.groupBy("low", "piece").applyInPandas(search, _RANGES)


def _remove(data: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs, SHA-256 of the rest."""
    kept, removed, runs, at = hashlib.sha256(), 0, 0, 0
    start = stop = None
    for a, b in [*sorted(ranges), (len(data) + 1, len(data) + 1)]:
        if stop is not None and a <= stop:
            stop = max(stop, b)
            continue
        if stop is not None:
            kept.update(data[at:start])
            removed, runs, at = removed + stop - start, runs + 1, stop
        start, stop = a, b
    kept.update(data[at:])
    return removed, runs, kept.hexdigest()


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
             chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "suffix")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(os.path.join(folder, name))
        return spark.read.parquet(os.path.join(folder, name))

    marked = stored(marks(docs, key, text, length, gram), "marks")
    texts = stored(touched(docs, marked, text), "texts")
    places = stored(_cut(texts, length, with_bytes=False), "places")
    large = places.groupBy("low", "sid").agg(F.max("size").alias("size")).groupBy("low").agg(F.sum("size").alias("size")) \
        .where(F.col("size") > shard_bytes).select("low", F.ceil(F.col("size") / shard_bytes).cast("int").alias("parts"))
    large = stored(large, "large")
    whole = _cut(texts, length, with_bytes=True).join(large, "low", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    shards = whole.select("low", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), "sid", "copies", "bytes", "parts")
    sorted_ = lambda df: df.repartition("low", "part").sortWithinPartitions("low", "part", "sid")
    found = repeated(sorted_(shards), length, chunk_bytes)
    if not large.isEmpty():
        found = found.union(merged(sorted_(shards.where(F.col("parts") > 1)), length, chunk_bytes))
    found = stored(found, "found")
    ranges = places.select("sid", "tid", "at").join(found, "sid") \
        .select("tid", F.transform("ranges", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b"))).alias("r")) \
        .groupBy("tid").agg(F.flatten(F.collect_list("r")).alias("ranges"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = [(tid, *_remove(t.encode("utf-8", "replace"), [(x["a"], x["b"]) for x in r]))
                    for tid, t, r in zip(*(c.to_pylist() for c in batch.columns))]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["r_tid", "gone", "runs", "rest"])

    cut = texts.select("tid", "text").join(ranges, "tid").mapInArrow(work, "r_tid string, gone long, runs long, rest string")
    copies = marked.groupBy("tid").agg(F.count("*").alias("copies")).where(F.col("copies") > 1).select(F.col("tid").alias("c_tid"))
    known = cut.join(copies, F.col("r_tid") == F.col("c_tid"), "full").select(
        F.coalesce("r_tid", "c_tid").alias("r_tid"), "gone", "runs", "rest", F.col("c_tid").isNotNull().alias("copied"))
    joined = marked.join(known, F.col("tid") == F.col("r_tid"), "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    return joined.select(
        key, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("rest", "tid")).alias("kept_sha256"))
