r"""Phrase collocations by set-oriented mining of sorted occurrence relations (SETM).

Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces, and those at spaces and tabs into words.
Everything is counted per language; a null language is ``und``, a null text empty.

The occurrence relation of length k lists where a frequent phrase of k words starts, sorted by piece and position. It is
persisted in runs: a row holds some RUN_WORDS words of consecutive pieces (a longer piece is not cut), so a reader may
split the table anywhere and never parts a piece. Words are numbers in compressed bytes, starts are bits. A relation is
removed when the next one is written. Each length takes four steps:

1. merge-join of the relation with itself by piece and adjacent position: k words start where the (k-1)-word phrases at a
   position and at the next one are both frequent (a zero word separates pieces, so nothing joins across them);
2. group-count: a run sends each of its distinct phrases once, with its count, to the bucket of the phrase's hash, packed
   with the others for that bucket, and the buckets add up; a phrase that is a third of all text sends one count a run;
3. groups of at least ``least`` occurrences are kept, under exact keys: the words' numbers, which come from the same count
   of single words and are kept in a table;
4. semi-join with the frequent groups: the bucket tells every run which of the phrases it sent are among them, a bit each,
   and the run writes the relation of length k.

The number of buckets follows the corpus, so a bucket's size does not. Join sides are left to Spark's own size checks. Counts are longs; scores are worked out in 38-digit decimals, in integers.

Repeated rows count as often as they occur; ids take no part. Extra columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.llm.rows import slices
from docketflow.operators.ordering import running_total, top_per_group
from docketflow.session import remove_path, scratch_path

LONGEST = 5
LEAST = 100
TOP = 2_000
COVER = 100
SCALE = 1_000
RUN_WORDS = 1 << 20
#: Bytes of packed words for each bucket in which phrases are counted; a bucket has at most about as many phrases.
PHRASES_A_BUCKET = 1 << 20
NO_LANGUAGE = "und"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_UNITS = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_ENDS = frozenset(b".,;:!?\n\v\f\r")
SLICE_BYTES = 1 << 20
#: A word's number as a key: four bytes, the highest first.
ID_BYTES = 4
MOST_WORDS = 1 << 31

_RUN = "run long, words binary, langs array<string>, lang_of binary, hashes binary, counts binary, spelled binary"
_RUN_ARROW = pa.schema([("run", pa.int64()), ("words", pa.binary()), ("langs", pa.list_(pa.string())), ("lang_of", pa.binary()),
                        ("hashes", pa.binary()), ("counts", pa.binary()), ("spelled", pa.binary())])
_RELATION = "run long, words binary, starts binary"
_RELATION_ARROW = pa.schema([("run", pa.int64()), ("words", pa.binary()), ("starts", pa.binary())])


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, the bytes of equal weight together, compressed."""
    return zstandard.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _packed_starts(starts: np.ndarray, size: int) -> bytes:
    flags = np.zeros(size, bool)
    flags[starts] = True
    return zstandard.compress(np.packbits(flags).tobytes(), 1)


def _unpacked_starts(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8)))


class _Codes(dict):
    """Numbers of the words of one language in a run, given as they are first met; of what ends a piece: 0."""

    def __init__(self, names: list[tuple[int, bytes]], lang_no: int):
        super().__init__()
        self._names, self._lang_no = names, lang_no

    def __missing__(self, word: bytes) -> int:
        code = 0
        if word[0] not in _ENDS:
            self._names.append((self._lang_no, word))
            code = len(self._names)
        self[word] = code
        return code


class _Run:
    """Words of consecutive pieces, numbered from 1 as they are first met; zeros between pieces."""

    def __init__(self, number: int, full: int):
        self.number, self._full = number, full
        self._start()

    def _start(self) -> None:
        self._parts, self._size, self._names, self._codes = [np.zeros(1, np.int32)], 1, [], {}

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        """Appends a text, in slices that end with a piece; gives the run whenever it is full, and goes on with the next."""
        data, at = text.encode("utf-8", "replace").translate(_LOWER), 0
        while at < len(data):
            end = _END.search(data, at + SLICE_BYTES)
            to = end.start() if end else len(data)
            codes = self._codes.get(lang)
            if codes is None:
                codes = self._codes[lang] = _Codes(self._names, len(self._codes))
            words = _UNITS.findall(data, at, to)
            self._parts += [np.fromiter(map(codes.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
            self._size, at = self._size + len(words) + 1, to
            if self._size > self._full:
                yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self._names:
            words, langs = np.concatenate(self._parts), list(self._codes)
            lang_of = np.fromiter((no for no, _ in self._names), np.int32, len(self._names))
            seeds = [xxhash.xxh32_intdigest(lang) for lang in langs]
            hashes = np.fromiter((xxhash.xxh32_intdigest(word, seeds[no]) for no, word in self._names), np.uint32, len(self._names))
            values = [_packed(lang_of), _packed(hashes.view(np.int32)), _packed(np.bincount(words, minlength=len(lang_of) + 1)[1:]),
                      zstandard.compress(b"\n".join(word for _, word in self._names), 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array([self.number], pa.int64()), pa.array([_packed(words)], pa.binary()), pa.array([langs], pa.list_(pa.string())),
                *[pa.array([v], pa.binary()) for v in values]], schema=_RUN_ARROW)
        self.number += 1
        self._start()


def runs(docs: DataFrame, text: str = "text", lang: str = "lang", run_words: int = RUN_WORDS) -> DataFrame:
    """The texts as runs: ``words`` are places, from 1, in the list of the run's distinct words, and 0 between pieces.

    Of every distinct word there are the language (a place in ``langs``), a hash, its count and its spelling. A run's number is the task's partition and a running number, so a task that is run again makes the same runs.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        run = _Run((context.partitionId() if context else 0) << 33, run_words)
        for part in slices(batches):
            for language, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield from run.add(NO_LANGUAGE if language is None else language, value or "")
        yield from run.close()

    given = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("text <> ''")
    return given.mapInArrow(make, _RUN)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a relation: run, words, starts; and further columns as they are."""
    for batch in batches:
        for run, words, starts, *rest in zip(*batch.columns):
            yield run.as_py(), _unpacked(words.as_py()), _unpacked_starts(starts.as_py()), *rest


def _array(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def _groups(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For phrases of ``size`` words at ``starts``: the first start of each distinct one, and the group of every start.

    Groups are numbered by their words, prefix by prefix; word numbers and groups of a run stay below 2^31, so a group and
    the next word fit 63 bits.
    """
    group, first = words[starts].astype(np.int64), np.zeros(0, np.int64)
    for i in range(1, size):
        _, first, group = np.unique(group << 31 | words[starts + i], return_index=True, return_inverse=True)
    return starts[first], group


def _starts(before: np.ndarray) -> np.ndarray:
    """Merge-join by adjacent position: where one phrase of the relation starts, and another one at the next word."""
    return before[:-1][np.diff(before) == 1]


def _buckets(words: np.ndarray, before: np.ndarray, size: int, buckets: int):
    """The distinct phrases of a run dealt out by a hash of their words.

    (phrases by bucket as rows of word numbers, their counts, where each bucket begins; starts, the place of every start's
    phrase in that order). The same run gives the same order every time.
    """
    starts = _starts(before)
    first, group = _groups(words, starts, size)
    keys = words[first[:, None] + np.arange(size)].reshape(-1, size)
    bucket = _hashed(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    times = np.bincount(group, minlength=len(first))[order]
    return keys[order], times, np.searchsorted(bucket[order], np.arange(buckets + 1)), starts, place[group]


def _hashed(keys: np.ndarray, buckets: int) -> np.ndarray:
    value = np.zeros(len(keys), np.uint64)
    for column in keys.T:
        value = (value ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return (value % np.uint64(buckets)).astype(np.int64)


def _sent(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Phrases and counts, column by column; the first words ascend and are sent as differences."""
    columns = np.vstack([keys.T, times]).astype(np.int64)
    columns[0, 1:] -= columns[0, :-1].copy()
    return _packed(columns.ravel())


def _received(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    columns = _unpacked(data).reshape(size + 1, -1).astype(np.int64)
    columns[0] = np.cumsum(columns[0])
    return columns[:size].T, columns[size]


def occurrences(relation: DataFrame, size: int, buckets: int) -> DataFrame:
    """bucket, run, data: the distinct phrases of ``size`` words of every run and how often it has them, packed."""
    schema = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("data", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, words, before in _rows(batches):
            keys, times, cuts, _, _ = _buckets(words, before, size, buckets)
            full = np.flatnonzero(np.diff(cuts))
            if len(full):
                data = [_sent(keys[cuts[b]:cuts[b + 1]], times[cuts[b]:cuts[b + 1]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), run)),
                                                  pa.array(data, pa.binary())], schema=schema)

    return relation.select("run", "words", "starts").mapInArrow(send, "bucket int, run long, data binary")


def counted(met: DataFrame, size: int, least: int) -> DataFrame:
    """Group-count of each bucket: bucket, run, kept (bits: which of the run's phrases are frequent), groups (w, a).

    Every phrase lies in one bucket, whose number of phrases is set by the number of buckets. A bucket's frequent phrases
    are in its first row; runs without any have no row.
    """
    schema = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("kept", pa.binary()),
                        ("groups", pa.list_(pa.struct([("w", pa.binary()), ("a", pa.int64())])))])

    def count(table: pa.Table) -> pa.Table:
        keys, times = zip(*(_received(x.as_py(), size) for x in table.column("data")))
        ends = np.cumsum([len(t) for t in times])
        keys, times = np.concatenate(keys), np.concatenate(times)
        group, first = keys[:, 0], np.zeros(0, np.int64)
        for i in range(1, size):
            _, first, group = np.unique(group << 31 | keys[:, i], return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, group, times)
        frequent = total >= least
        held, found = frequent[group], np.flatnonzero(frequent)
        if not len(found):
            return schema.empty_table()
        w = [row.tobytes() for row in keys[first[found]].astype(">i4")]
        groups = [[{"w": x, "a": y} for x, y in zip(w, total[found].tolist())]]
        rows = [(run, held[a:b]) for run, a, b in zip(table.column("run").to_pylist(), [0, *ends[:-1]], ends) if held[a:b].any()]
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_arrays([
            pa.array([bucket] * len(rows), pa.int32()), pa.array([run for run, _ in rows], pa.int64()),
            pa.array([np.packbits(bits).tobytes() for _, bits in rows], pa.binary()),
            pa.array(groups + [[]] * (len(rows) - 1), schema.field("groups").type)], schema=schema)

    return met.groupBy("bucket").applyInArrow(count, "bucket int, run long, kept binary, groups array<struct<w: binary, a: long>>")


def shrunk(relation: DataFrame, kept: DataFrame, size: int, buckets: int) -> DataFrame:
    """The relation of length ``size``, by a semi-join with what each run kept: run, words, starts.

    Words of no kept phrase are gone. ``kept`` has run, bucket, kept.
    """
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, words, before, numbers, bits in _rows(batches):
            keys, _, cuts, starts, place = _buckets(words, before, size, buckets)
            held = np.zeros(len(keys), bool)
            for bucket, flags in zip(numbers.as_py(), bits.as_py()):
                a, b = cuts[bucket], cuts[bucket + 1]
                held[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=b - a)
            yield _relation(run, words, starts[held[place]], size)

    mine = kept.groupBy(F.col("run").alias("of")).agg(F.collect_list(F.struct("bucket", "kept")).alias("mine"))
    return relation.join(mine, F.col("run") == F.col("of")) \
        .select("run", "words", "starts", F.col("mine.bucket").alias("buckets"), F.col("mine.kept").alias("kept")).mapInArrow(keep, _RELATION)


def _relation(run: int, words: np.ndarray, starts: np.ndarray, size: int) -> pa.RecordBatch:
    """One run with only the words that its phrases cover; a zero stands where others were."""
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    held = np.cumsum(cover[:-1]) > 0
    stays = held | np.concatenate([[True], held[:-1]])
    rest, at = np.where(held, words, 0)[stays], (np.cumsum(stays) - 1)[starts]
    return pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([_packed(rest)], pa.binary()),
                                       pa.array([_packed_starts(at, len(rest))], pa.binary())], schema=_RELATION_ARROW)


def _dealt(lang_of: bytes, hashes: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A run's distinct words by bucket and language: their order, where each stretch begins and ends, and its bucket and language."""
    lang, bucket = _unpacked(lang_of), _unpacked(hashes).view(np.uint32) % np.uint32(min(buckets, (1 << 32) - 1))
    order = np.lexsort((lang, bucket))
    lang, bucket = lang[order], bucket[order].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1]), [True]]))
    return order, cuts, bucket[cuts[:-1]], lang[cuts[:-1]]


def word_counts(run_table: DataFrame, buckets: int, least: int) -> DataFrame:
    """Group-count of the words, in buckets by their hash: bucket, run, lang, places, words, totals.

    Runs send their distinct words with their counts. ``places`` says of each that a run sent where it stands among the
    bucket's frequent ones, from 1, or 0. A bucket's first row lists these (lang, word, a) and the occurrences of all its
    words by language.
    """
    sent = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("lang", pa.string()), ("counts", pa.binary()), ("spelled", pa.binary())])
    word = pa.struct([("lang", pa.string()), ("word", pa.string()), ("a", pa.int64())])
    total = pa.struct([("lang", pa.string()), ("n", pa.int64())])
    schema = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("lang", pa.string()), ("places", pa.binary()),
                        ("words", pa.list_(word)), ("totals", pa.list_(total))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, langs, lang_of, hashes, counts, spelled in zip(*(c.to_pylist() for c in batch.columns)):
                order, cuts, bucket, lang = _dealt(lang_of, hashes, buckets)
                counts, spelled = _unpacked(counts)[order], np.array(zstandard.decompress(spelled).split(b"\n"), object)[order]
                ends = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket), pa.array([run] * len(ends), pa.int64()), pa.array([langs[i] for i in lang]),
                    pa.array([_packed(counts[a:b]) for a, b in ends], pa.binary()),
                    pa.array([zstandard.compress(b"\n".join(spelled[a:b]), 1) for a, b in ends], pa.binary())], schema=sent)

    def count(table: pa.Table) -> pa.Table:
        rows = [(run, lang, zstandard.decompress(spelled).split(b"\n"), _unpacked(counts).tolist())
                for run, lang, counts, spelled in zip(*(table.column(c).to_pylist() for c in ("run", "lang", "counts", "spelled")))]
        met: dict[tuple[str, bytes], int] = defaultdict(int)
        for _, lang, words, counts in rows:
            for one, n in zip(words, counts):
                met[lang, one] += n
        totals: Counter = Counter()
        for (lang, _), n in met.items():
            totals[lang] += n
        frequent = sorted(key for key, n in met.items() if n >= least)
        place = {key: i for i, key in enumerate(frequent, 1)}
        places = [np.fromiter((place.get((lang, one), 0) for one in words), np.int32, len(words)) for _, lang, words, _ in rows]
        kept = [i for i, p in enumerate(places) if p.any() or not i]
        lists = [[{"lang": lang, "word": one.decode(), "a": met[lang, one]} for lang, one in frequent]]
        sums = [[{"lang": lang, "n": n} for lang, n in totals.items()]]
        return pa.Table.from_arrays([
            pa.array([table.column("bucket")[0].as_py()] * len(kept), pa.int64()), pa.array([rows[i][0] for i in kept], pa.int64()),
            pa.array([rows[i][1] for i in kept], pa.string()), pa.array([_packed(places[i]) for i in kept], pa.binary()),
            pa.array(lists + [[]] * (len(kept) - 1), pa.list_(word)), pa.array(sums + [[]] * (len(kept) - 1), pa.list_(total))], schema=schema)

    return run_table.select("run", "langs", "lang_of", "hashes", "counts", "spelled") \
        .mapInArrow(send, "bucket long, run long, lang string, counts binary, spelled binary").groupBy("bucket") \
        .applyInArrow(count, "bucket long, run long, lang string, places binary, "
                      "words array<struct<lang: string, word: string, a: long>>, totals array<struct<lang: string, n: long>>")


def _numbered(run_table: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """The relation of length 1: run, words (numbers of frequent words, others 0), starts.

    ``answers`` has run, bucket, lang, places, and base: the number before the first of the bucket's words.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, codes, langs, lang_of, hashes, mine in zip(*(c.to_pylist() for c in batch.columns)):
                order, cuts, bucket, lang = _dealt(lang_of, hashes, buckets)
                stretch = {(b, langs[i]): (x, y) for b, i, x, y in zip(bucket.tolist(), lang.tolist(), cuts, cuts[1:])}
                table = np.zeros(len(order) + 1, np.int32)
                for one in mine:
                    a, b = stretch[one["bucket"], one["lang"]]
                    places = _unpacked(one["places"])
                    table[1 + order[a:b]] = np.where(places, places + one["base"], 0)
                words = table[_unpacked(codes)]
                yield _relation(run, words, np.flatnonzero(words), 1)

    mine = answers.groupBy(F.col("run").alias("of")).agg(F.collect_list(F.struct("bucket", "lang", "places", "base")).alias("mine"))
    return run_table.join(mine, F.col("run") == F.col("of")).select("run", "words", "langs", "lang_of", "hashes", "mine") \
        .mapInArrow(number, _RELATION)


class Mined:
    """Tables of a mining run below one scratch folder; ``close`` (or ``with``) removes them."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 run_words: int = RUN_WORDS):
        self.spark, self.longest = docs.sparkSession, longest
        self.folder = scratch_path(self.spark, "phrases")
        run_table = self._stored(runs(docs, text, lang, run_words).withColumn("size", F.length("words")), "runs")
        # Compressed words take a byte or two each.
        buckets = (run_table.agg(F.sum("size")).first()[0] or 0) // PHRASES_A_BUCKET + 1
        met = self._stored(word_counts(run_table, buckets, least), "groups-1")
        #: lang, n: all word occurrences
        self.totals = self._stored(met.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n")), "totals")
        sizes = met.where(F.size("words") > 0).select("bucket", F.size("words").alias("size"))
        bases = self._stored(running_total(sizes, [], ["bucket"], F.col("size"), "upto")
                             .select("bucket", (F.col("upto") - F.col("size")).alias("base")), "bases")
        listed = met.select("bucket", F.posexplode("words").alias("at", "x")).join(bases, "bucket")
        #: lang, word, a, no, id (no as a key) of the frequent words: numbers from 1, stored, so they are exact
        self.words = self._stored(_with_keys(listed.select("x.lang", "x.word", "x.a", (F.col("base") + F.col("at") + 1).alias("no"))), "numbers")
        answers = met.select("run", "bucket", "lang", "places").join(bases, "bucket")
        relation = self._stored(_numbered(run_table, answers, buckets), "relation-1")
        self._remove("runs")
        groups = [self.words.select(F.col("id").alias("w"), "a")]
        for size in range(2, longest + 1):
            found = self._stored(counted(occurrences(relation, size, buckets), size, least), f"groups-{size}")
            groups.append(found.select(F.explode("groups").alias("g")).select("g.w", "g.a"))
            if size < longest:
                relation = self._stored(shrunk(relation, found.select("run", "bucket", "kept"), size, buckets), f"relation-{size}")
            self._remove(f"relation-{size - 1}")
        #: w, a: the words' keys and the occurrences of every frequent phrase of 1 to ``longest`` words
        self.groups = reduce(DataFrame.unionByName, groups)

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        # Spark removes the shuffle files of what nobody holds any more when the driver's memory is cleared.
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _remove(self, name: str) -> None:
        remove_path(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        remove_path(self.spark, self.folder)

    def __enter__(self) -> Mined:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _with_keys(words: DataFrame) -> DataFrame:
    """Words with the keys of their numbers; more frequent words than there are numbers are an error, not a wrap."""
    fits = F.when(F.col("no") < MOST_WORDS, F.col("no")).otherwise(F.raise_error(F.lit("too many frequent words")).cast("long"))
    return words.withColumn("no", fits.cast("int")).withColumn("id", F.unhex(F.lpad(F.hex("no"), 2 * ID_BYTES, "0")))


def _size(phrase: Column) -> Column:
    return F.floor(F.length(phrase) / ID_BYTES).cast("int")


def _part(phrase: Column, at: Column, size: Column) -> Column:
    """``size`` words of a phrase from the ``at``-th, counted from 0."""
    return F.substr(phrase, at * ID_BYTES + 1, size * ID_BYTES)


def scored(mined: Mined) -> DataFrame:
    """w, lang, a, l, r, n, score of every candidate: the cut with the lowest score, the first of equals."""
    w = F.col("w")
    phrases = mined.groups.where(_size(w) > 1)
    cuts = phrases.select("w", "a", F.explode(F.sequence(F.lit(1), _size(w) - 1)).alias("k"))
    parts = mined.groups
    cuts = cuts.select("w", "a", "k", _part(w, F.lit(0), F.col("k")).alias("head"), _part(w, F.col("k"), _size(w) - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select(w.alias("head"), F.col("a").alias("l")), "head") \
        .join(parts.select(w.alias("rest"), F.col("a").alias("r")), "rest")
    langs = mined.words.select("id", "lang").join(mined.totals, "lang")
    cuts = cuts.join(langs, _part(w, F.lit(0), F.lit(1)) == F.col("id"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    best = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r"), F.col("n"))) \
        .groupBy("w", "lang", "a", "n").agg(lowest.alias("best"))
    return best.select("w", "lang", "a", "best.l", "best.r", "n", "best.score")


def score(a: Column, l: Column, r: Column, n: Column) -> Column:  # noqa: E741
    """floor(SCALE * a * n / (l * r)) without rounding: both products fit 38 digits, and the quotient a long."""
    wide = [x.cast("decimal(16,0)") for x in (a, n, l, r)]
    above = (F.lit(SCALE).cast("decimal(4,0)") * wide[0].cast("decimal(16,0)")) * wide[1]
    return F.call_function("div", above, wide[2] * wide[3])


def covered(mined: Mined, cover: int = COVER) -> DataFrame:
    """w of the phrases that lie contiguously in a longer one with 100 * f(longer) >= ``cover`` * f(phrase)."""
    w = F.col("w")
    longer = mined.groups.where(_size(w) > 2)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), _size(w) - 1), lambda size: F.transform(
        F.sequence(F.lit(0), _size(w) - size), lambda at: _part(w, at, size))))
    most = longer.select("a", F.explode(inner).alias("w")).groupBy("w").agg(F.max("a").alias("most"))
    return mined.groups.join(most, "w").where(F.col("most") * 100 >= F.col("a") * cover).select("w")


def collocations(mined: Mined, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score, occurrences, phrase.

    Phrases are spelled out for those only that can be among the first: all of the rank that closes the list.
    """
    left = scored(mined).join(covered(mined, cover), "w", "left_anti")
    near = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    near = left.withColumn("near", near).where(F.col("near") <= top).drop("near")
    spelled = near.select(F.struct(*near.columns).alias("kept"), F.posexplode(F.transform(
        F.sequence(F.lit(0), _size(F.col("w")) - 1), lambda i: _part(F.col("w"), i, F.lit(1)))).alias("at", "id")) \
        .join(mined.words.select("id", "word"), "id") \
        .groupBy("kept").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    rows = spelled.select("kept.*", F.array_join("spelled.word", " ").alias("phrase"))
    ranked = top_per_group(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS ws
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, any_value(ws) AS ws, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING k = 1 OR count(*) >= 100),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
cuts AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, n,
    ((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.ws[1:j], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.ws[j + 1:], ' ') JOIN t ON t.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) u(m) WHERE m < k)),
o AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY lang, phrase),
q AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM q QUALIFY rank <= 2000
"""
