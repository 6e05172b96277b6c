"""Dictionary tagging with more phrases than a task can hold: every share of the texts gets the phrases it can use.

Texts are dealt out by a hash to shares of bounded size. In place of word groups, digests of them travel, and only once:

1. from the dictionary come Bloom filters, one for each number of words, of a bounded size in all, sent to every task;
2. each task digests the word groups of its texts, keeps those that may be phrases, and asks for each once, with the shares
   it occurs in: sorted, packed, one block for each bucket of digests;
3. a bucket holds its part of the dictionary and answers each share with the phrases that were asked for;
4. a share's answers meet its texts: phrases are found by digest and compared word by word, so a digest that meets by chance
   costs a little and changes nothing. Of the hits the leftmost, then longest are kept, as in the automaton.

So the texts are shuffled once, and the work follows the texts plus the dictionary. Filters past their bound let more through
by chance, at most a question for each place and number of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a share's texts, on average, and of the texts a task works on at a time; shares a task has, on average.
SHARE_CHARACTERS = 1 << 22
_PIECE = 1 << 20
_SHARES = 4
#: Filters have 16 bits a phrase, and so many 64-bit words in all at most; they are built in slices.
FILTER_WORDS = 1 << 23
_SLICE_WORDS = 1 << 15
#: Longer phrases are asked for by their first words, a power of two of them.
_LONGEST_KEY = 8
#: Questions a task holds before it sends them; forms it remembers; phrases of a bucket.
_QUESTIONS = 1 << 21
_FORMS = 1 << 18
_BUCKET = 200_000
#: A question: 40 bits of the digest, 24 of the share.
_SHARE_BITS = np.uint64(24)
_MOST_SHARES = 1 << 24

#: Signs between words, signs that forms drop, and a form that no word has.
_BREAKS = "\n\t\r"
_DROP = ".,;:!?()"
_OTHER = " "
_STEP = 0x9E3779B97F4A7C15


class _Forms(dict):
    """Numbers of match forms, given as they are first met, and their hashes."""

    def __init__(self):
        super().__init__()
        self._hashes = np.zeros(1 << 10, np.uint64)

    def __missing__(self, form: str) -> int:
        number = self[form] = len(self)
        if number == len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.zeros_like(self._hashes)])
        self._hashes[number] = xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass"))
        return number

    def numbers(self, forms: Iterable[str], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, forms), np.int64, count)

    def known(self, forms: Iterable[str], count: int) -> np.ndarray:
        """As numbers, but forms that were not met get none: that of a word outside all texts."""
        return np.fromiter(map(self.get, forms, repeat(self[_OTHER])), np.int64, count)

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        return self._hashes[numbers]


class _Digests:
    """Digests of any stretch of a row of words, from running sums: a stretch has the same one wherever it stands."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        if len(self._up) < len(hashes):
            for name, step in (("_up", _STEP), ("_down", pow(_STEP, -1, 1 << 64))):
                steps = np.full(2 * len(hashes), step, np.uint64)
                steps[0] = 1
                setattr(_Digests, name, np.cumprod(steps))
        self._sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self._up[:len(hashes)], out=self._sums[1:])

    def all(self, n: int) -> np.ndarray:
        """Of the ``n`` words from every place that has as many behind it."""
        sums = self._sums[n:] - self._sums[:-n]
        return self._mixed(sums * self._down[:len(sums)])

    def at(self, places: np.ndarray, n) -> np.ndarray:
        return self._mixed((self._sums[places + n] - self._sums[places]) * self._down[places])

    @staticmethod
    def _mixed(sums: np.ndarray) -> np.ndarray:
        sums ^= sums >> np.uint64(29)
        sums *= np.uint64(0xBF58476D1CE4E5B9)
        sums ^= sums >> np.uint64(32)
        return sums


def _filter_words(phrases: int) -> int:
    return 1 << max(4, (phrases // 4).bit_length())


def _places(digests: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter of ``size`` words that a digest marks, and its three bits there."""
    one, six = np.uint64(1), np.uint64(63)
    bits = one << (digests & six) | one << (digests >> np.uint64(6) & six) | one << (digests >> np.uint64(12) & six)
    return (digests >> np.uint64(65 - size.bit_length())).astype(np.int64), bits


def _marked(digests: np.ndarray, size: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """The filter of the digests, or ``count`` words of it from ``first`` on."""
    words = np.zeros(size if count is None else count, np.uint64)
    at, bits = _places(digests, size)
    np.bitwise_or.at(words, at - first, bits)
    return words


def _maybe(words: np.ndarray, digests: np.ndarray) -> np.ndarray:
    at, bits = _places(digests, len(words))
    return words[at] & bits == bits


def _without(signs: str, text: str, put: str = "") -> str:
    """Replaced one by one, which is many times as fast as ``translate`` once a text has a sign outside ASCII."""
    for sign in signs:
        text = text.replace(sign, put)
    return text


def _key_length(n: int) -> int:
    return n if n <= _LONGEST_KEY else 1 << n.bit_length() - 1


class _Piece:
    """Some texts as one row of words."""

    def __init__(self, texts: list[str | None], forms: Callable[[list[str], int], np.ndarray], hashes: Callable[[np.ndarray], np.ndarray]):
        rows = [[w for w in _without(_BREAKS, text or "", " ").split(" ") if w] for text in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.words = [w for row in rows for w in row]
        self.whole = " ".join(self.words)
        self.numbers = forms(_without(_DROP, self.whole).lower().split(" "), len(self.words))
        self.begins = np.cumsum(sizes) - sizes
        self.text_of = np.repeat(np.arange(len(rows)), sizes)
        self.left = np.repeat(self.begins + sizes, sizes) - np.arange(len(self.words))
        self.digests = _Digests(hashes(self.numbers))

    def fitting(self, n: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``n`` words of one text that may be in the filter, and their digests."""
        if n > len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found = self.digests.all(n)
        places = np.flatnonzero(_maybe(words, found) & (self.left[:len(found)] >= n))
        return places, found[places]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of texts of a bounded number of characters together; a longer one is alone."""
    begin, size = 0, 0
    for at, more in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if size and size + more > _PIECE:
            yield begin, at
            begin, size = at, 0
        size += more
    if begin < len(texts):
        yield begin, len(texts)


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers: their steps, the bytes of equal weight together, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _merged(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The distinct values, in order; parts are merged as they come."""
    held: list[np.ndarray] = [np.zeros(0, np.uint64)]
    size, known = 0, 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size > max(_QUESTIONS, 2 * known):
            held = [np.unique(np.concatenate(held))]
            size = known = len(held[0])
    return np.unique(np.concatenate(held))


def _buckets(digests: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the digests' first 40 bits."""
    return ((digests >> _SHARE_BITS) * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)


# --- the steps ----------------------------------------------------------------------------------------------------

def _key_words(gram: Column) -> Column:
    n = F.size(F.split(gram, " "))
    return F.when(n <= _LONGEST_KEY, n).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 1))


def _keyed(phrases: DataFrame, buckets: int) -> DataFrame:
    """Phrases with the digest they are asked for by: bucket, k, h, gram, tag."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _Forms()
        for batch in batches:
            if not len(batch):
                continue
            if len(forms) > _FORMS:
                forms = _Forms()
            grams = [g.split(" ") for g in batch.column(0).to_pylist()]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            numbers = forms.numbers((w for g in grams for w in g), int(sizes.sum()))
            keys = np.fromiter(map(_key_length, sizes.tolist()), np.int64, len(grams))
            found = _Digests(forms.hashes(numbers)).at(np.cumsum(sizes) - sizes, keys)
            yield pa.RecordBatch.from_arrays([pa.array(_buckets(found, buckets)), pa.array(keys), pa.array(found.view(np.int64)),
                                              *batch.columns], ["bucket", "k", "h", "gram", "tag"])

    return phrases.select("gram", "tag").mapInArrow(run, "bucket long, k long, h long, gram string, tag string")


def _filters(keyed: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The Bloom filter of each number of key words; it comes to the driver in slices."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        k, part = (x.as_py() for x in key)
        count = min(sizes[k], _SLICE_WORDS)
        words = _marked(rows["h"].to_numpy().view(np.uint64), sizes[k], part * count, count)
        return pa.table({"k": pa.array([k]), "part": pa.array([part], pa.int32()), "words": pa.array([words.tobytes()], pa.binary())})

    parts = F.lit(0)
    for k, size in sizes.items():
        if size > _SLICE_WORDS:
            shift = 64 - (size // _SLICE_WORDS).bit_length() + 1
            parts = F.when(F.col("k") == k, F.call_function("shiftrightunsigned", F.col("h"), F.lit(shift)).cast("int")).otherwise(parts)
    made = keyed.select("k", "h", parts.alias("part")).groupBy("k", "part").applyInArrow(run, "k long, part int, words binary").toArrow()
    found = {k: np.zeros(size, np.uint64) for k, size in sizes.items()}
    for k, part, words in zip(*[made[c].to_pylist() for c in ("k", "part", "words")]):
        held = np.frombuffer(words, np.uint64)
        found[k][part * len(held):(part + 1) * len(held)] = held
    return found


def _questions(texts: DataFrame, filters, buckets: int) -> DataFrame:
    """Blocks of questions (bucket, block): digests that may be phrases, each once a task with the shares it occurs in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, held, size = _Forms(), [], 0
        for batch in batches:
            shares, column = batch.column(0).to_numpy().astype(np.uint64), batch.column(1)
            for begin, end in _pieces(column):
                if len(forms) > _FORMS:
                    forms = _Forms()
                piece = _Piece(column[begin:end].to_pylist(), forms.numbers, forms.hashes)
                share_of = shares[begin:end][piece.text_of]
                for k, words in filters.value.items():
                    places, found = piece.fitting(k, words)
                    held.append(np.unique(found >> _SHARE_BITS << _SHARE_BITS | share_of[places]))
                    size += len(held[-1])
                if size > _QUESTIONS:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        asked = np.unique(np.concatenate(held))
        to = _buckets(asked, buckets)
        cuts = np.flatnonzero(np.diff(to)) + 1
        return pa.RecordBatch.from_arrays([pa.array(to[np.append(0, cuts)]),
                                           pa.array([_packed(part) for part in np.split(asked, cuts)], pa.binary())], ["bucket", "block"])

    return texts.select("share", "text").mapInArrow(run, "bucket long, block binary")


_ANSWER = pa.schema([("share", pa.int32()), ("grams", pa.string()), ("tags", pa.list_(pa.string()))])


def _answered(asked: pa.Table, phrases: pa.Table) -> pa.Table:
    """A bucket's phrases for each share that asked for them; grams hold no line ends, which separate them here."""
    if not len(asked) or not len(phrases):
        return _ANSWER.empty_table()
    digests = phrases["h"].to_numpy().view(np.uint64) >> _SHARE_BITS
    order = np.argsort(digests)
    digests = digests[order]
    pairs = _merged(_unpacked(b.as_py()) for b in asked["block"])
    wanted = pairs >> _SHARE_BITS
    first = np.searchsorted(digests, wanted)
    many = np.searchsorted(digests, wanted, "right") - first
    share = np.repeat((pairs & np.uint64(_MOST_SHARES - 1)).astype(np.int32), many)
    phrase = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(share))
    by_share = np.argsort(share, kind="stable")
    share, phrase = share[by_share], order[phrase[by_share]]
    starts = np.flatnonzero(np.diff(share, prepend=np.int32(-1)))
    offsets = pa.array(np.append(starts, len(share)).astype(np.int32))
    grams, tags = (pa.ListArray.from_arrays(offsets, phrases[c].combine_chunks().take(pa.array(phrase))) for c in ("gram", "tag"))
    return pa.table([pa.array(share[starts]), pc.binary_join(grams, "\n"), tags], schema=_ANSWER)


class _Share:
    """The phrases of one share, found by digest and compared word by word."""

    def __init__(self, grams: list[str], tags: list[str]):
        self.forms, self.tags = _Forms(), np.array(tags, object)
        split = [g.split(" ") for g in grams]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        self._numbers = self.forms.numbers((w for g in split for w in g), int(sizes.sum()))
        self._begins = np.cumsum(sizes) - sizes
        digests = _Digests(self.forms.hashes(self._numbers))
        self._lengths: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        self._filters: dict[int, np.ndarray] = {}
        keys: dict[int, list[np.ndarray]] = {}
        for n in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == n)
            found, k = digests.at(self._begins[of], n), _key_length(n)
            order = np.argsort(found)
            self._lengths.setdefault(k, []).append((n, found[order], of[order]))
            keys.setdefault(k, []).append(digests.at(self._begins[of], k))
        for k, found in keys.items():
            marks = np.concatenate(found)
            self._filters[k] = _marked(marks, _filter_words(len(marks)))

    def _equal(self, piece: _Piece, places: np.ndarray, phrases: np.ndarray, n: int) -> np.ndarray:
        same = np.ones(len(places), bool)
        for i in range(n):
            same &= piece.numbers[places + i] == self._numbers[self._begins[phrases] + i]
        return same

    def hits(self, piece: _Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and phrases of the leftmost, then longest matches."""
        size, phrase = np.zeros(len(piece.words), np.int64), np.zeros(len(piece.words), np.int64)
        for k, lengths in self._lengths.items():   # lengths ascend, over the keys and for each key: the longest stays
            near, near_digests = piece.fitting(k, self._filters[k])
            for n, known, of in lengths:
                fits = piece.left[near] >= n
                places = near[fits]
                digests = near_digests[fits] if n == k else piece.digests.at(places, n)
                at = np.searchsorted(known, digests)
                while len(places):   # phrases of equal digest, if ever, stand behind each other
                    there = np.flatnonzero(at < len(known))
                    there = there[known[at[there]] == digests[there]]
                    places, digests, at = places[there], digests[there], at[there]
                    same = self._equal(piece, places, of[at], n)
                    size[places[same]], phrase[places[same]] = n, of[at[same]]
                    places, digests, at = places[~same], digests[~same], at[~same] + 1
        begins = np.flatnonzero(size)
        kept, upto = [], 0
        for at, (begin, end) in enumerate(zip(begins.tolist(), (begins + size[begins]).tolist())):
            if begin >= upto:
                kept.append(at)
                upto = end
        begins = begins[np.array(kept, np.int64)]
        return begins, begins + size[begins], phrase[begins]


def _tagged(met: DataFrame, key_type: T.DataType) -> DataFrame:
    """Rows share, answer first, key, text, grams, tags, in this order within a task → key, start, end, text, tag."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, grams, tags, share = None, [], [], None
        for batch in batches:
            shares, answers = batch.column("share").to_numpy(), batch.column("answer").to_numpy()
            cuts = np.flatnonzero(np.diff(shares) | np.diff(answers)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if shares[begin] != number:
                    number, grams, tags, share = shares[begin], [], [], None
                if not answers[begin]:
                    for some, theirs in zip(part.column("grams").to_pylist(), part.column("tags").to_pylist()):
                        grams += some.split("\n")
                        tags += theirs
                elif grams:
                    share = share or _Share(grams, tags)
                    texts = part.column("text")
                    for first, last in _pieces(texts):
                        yield from rows(share, part.column("key")[first:last], texts[first:last].to_pylist())

    def rows(share: _Share, keys: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        piece = _Piece(texts, share.forms.known, share.forms.hashes)
        begins, ends, phrases = share.hits(piece)
        if not len(begins):
            return
        sizes = np.fromiter(map(len, piece.words), np.int64, len(piece.words))
        upto = np.cumsum(sizes + 1) - 1
        cut = [piece.whole[a:b] for a, b in zip((upto - sizes)[begins].tolist(), upto[ends - 1].tolist())]
        text = piece.text_of[begins]
        place = piece.begins[text]
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(text)), pa.array((begins - place).astype(np.int32)), pa.array((ends - place).astype(np.int32)),
             pa.array(cut, pa.string()), pa.array(share.tags[phrases], pa.string())], ["key", "start", "end", "text", "tag"])

    fields = [T.StructField("key", key_type), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
              T.StructField("text", T.StringType()), T.StructField("tag", T.StringType())]
    return met.mapInArrow(run, T.StructType(fields))


def tag_by_shares(df: DataFrame, key: str, text_column: str, phrases: DataFrame, share_characters: int = SHARE_CHARACTERS,
                  filter_words: int = FILTER_WORDS) -> DataFrame:
    """Rows key, start, end, text, tag of the matches of ``phrases`` (gram, tag; grams distinct), a table that is read again."""
    size = df.agg(F.sum(F.length(text_column))).first()[0] or 0
    shares = min(1 + size // share_characters, _MOST_SHARES)
    counts = {r["k"]: r["n"] for r in phrases.groupBy(_key_words(F.col("gram")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = min(1 + max(shares // 2, sum(counts.values()) // _BUCKET), _MOST_SHARES)
    sizes = {k: _filter_words(n) for k, n in sorted(counts.items())}
    while sum(sizes.values()) > filter_words and max(sizes.values()) > 16:
        largest = max(sizes, key=sizes.get)
        sizes[largest] //= 2
    keyed = _keyed(phrases, buckets)
    filters = df.sparkSession.sparkContext.broadcast(_filters(keyed, sizes))
    texts = df.select(F.col(key).alias("key"), F.col(text_column).alias("text")) \
        .select(F.pmod(F.xxhash64("key", "text"), F.lit(shares)).cast("int").alias("share"), "key", "text")
    answers = _questions(texts, filters, buckets).groupBy("bucket").cogroup(keyed.select("bucket", "h", "gram", "tag").groupBy("bucket")) \
        .applyInArrow(_answered, "share int, grams string, tags array<string>")
    nothing = F.lit(None)
    key_type = texts.schema["key"].dataType
    met = answers.select("share", F.lit(0).alias("answer"), nothing.cast(key_type).alias("key"), nothing.cast("string").alias("text"), "grams", "tags") \
        .unionByName(texts.select("share", F.lit(1).alias("answer"), "key", "text", nothing.cast("string").alias("grams"),
                                  nothing.cast("array<string>").alias("tags")))
    return _tagged(met.repartition(1 + shares // _SHARES, "share").sortWithinPartitions("share", "answer"), key_type).withColumnRenamed("key", key)
