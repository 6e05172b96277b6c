"""Token ids as Arrow files of equal-length sequences.

Format: an Arrow IPC file holds whole documents in ascending id order, one after the other, cut into sequences of
``length`` ids. Columns, one row per sequence:

* ``ids``: fixed-size list of unsigned 16-bit (or 32-bit, if the vocabulary needs it) ids,
* ``mask``: fixed-size list of booleans, false only on the padding that ends the last sequence of a file,
* ``documents``: list of (doc_id, at): the documents that begin in the sequence, and where.

Row i of a batch lies at a fixed offset in the file, so a memory map gives any sequence and its mask without copying.
A file is closed at the first document end beyond ``file_tokens`` ids; a longer document makes a longer file. Names
ascend with the ids. A task writes under a name of its own and renames when the file is complete, so a task that is run
again replaces whole files by equal ones; the manifest, written by Spark, lists the files that count.

The files lie below the shared folder. Tasks open it by pyarrow's file systems (local paths, file, hdfs, s3, gs).

Null texts are encoded like empty ones: they consist of the end id. Null ids come first; repeated ids keep all their
rows, ordered by text. An empty table gives no file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.operators.ordering import running_total

LENGTH = 2_048
FILE_TOKENS = 4_000_000
END_ID = 1
MAX_TOKENIZER_BYTES = 64_000_000
MEMO_CHUNKS = 350_000

#: Bytes of text cut into chunks at once.
SLICE_BYTES = 6_000_000
PIECES_AT_ONCE = 4_000

_LETTERS = "[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
_SIGNS = r"[!-&(-/:-@\[-`{-~]"
_PLAIN = f"^{_LETTERS}{_SIGNS}*$"
_PIECES = f"^({_LETTERS})({_SIGNS}+)$"
#: Characters that stand for bytes in the byte-level alphabet: themselves, or the next ones from 256 on for those that
#: are no printable character; a blank stays one.
_BYTE_CHARACTERS = np.arange(256, dtype="<u4")
_UNPRINTABLE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_CHARACTERS[_UNPRINTABLE] = 256 + np.arange(len(_UNPRINTABLE))
_BYTE_CHARACTERS[32] = 32


def read_tokenizer(path: str) -> bytes:
    """The tokenizer file, whose size is checked because it travels with the tasks."""
    with open(path, "rb") as file:
        data = file.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    return data


class ChunkEncoder:
    """Ids of whole texts; every distinct run of non-blank characters is encoded once.

    This holds for tokenizers that lower-case, drop white space and never look beyond it, which ``splits_at_blanks``
    says; texts that hold the beginning of a special token, and all texts of other tokenizers, are encoded as a whole.
    Arrow lower-cases A-Z, cuts and numbers the chunks. New ones go through the tokenizer many at a time:

    * Latin letters with punctuation behind them are the two pieces the tokenizer would make of them, and need none of its
      normalisation; the same model encodes them cut at blanks only, and word-end tokens tell the pieces apart;
    * all others go through the whole tokenizer, with MARK between them, whose id tells them apart; chunks that hold
      MARK go alone.

    When the memo holds MEMO_CHUNKS chunks, those go that no later slice asked for; that changes no result.
    """

    MARK = "\x01"

    def __init__(self, data: bytes, splits_at_blanks: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_buffer(data)
        self._mark = self._whole(self.MARK)
        self._split = splits_at_blanks and len(self._mark) == 1
        vocabulary = self._tokenizer.get_vocab()
        self.dtype = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        bare = json.loads(data)
        suffix = bare["model"].get("end_of_word_suffix")
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self._bare = Tokenizer.from_str(json.dumps(bare)) if suffix else None
        self._ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[str, int] = {}
        self._ids = np.zeros(0, self.dtype)
        self._ends = np.zeros(1, np.int64)   # where the ids of chunk i end, at i + 1
        self._asked = np.zeros(0, bool)

    def _keep_asked(self) -> None:
        """Forget all chunks that were met in one slice only; everything, if that leaves little room."""
        kept = np.flatnonzero(self._asked)
        if 4 * len(kept) > 3 * MEMO_CHUNKS:
            self._forget()
            return
        names = list(self._numbers)
        self._numbers = {names[i]: n for n, i in enumerate(kept)}
        sizes = self._ends[kept + 1] - self._ends[kept]
        stops = np.cumsum(sizes)
        self._ids = self._ids[np.arange(stops[-1] if len(stops) else 0) + np.repeat(self._ends[kept + 1] - stops, sizes)]
        self._ends = np.concatenate([[0], stops])
        self._asked = np.zeros(len(kept), bool)

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pieces(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and ends of chunks that are letters and punctuation; None if word ends don't tell them apart."""
        parted = pc.replace_substring_regex(pc.utf8_lower(chunks), _PIECES, r"\1 \2")
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(parted)], parted), " ")[0].as_buffer()
        text = _BYTE_CHARACTERS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self._bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        stops = np.flatnonzero(self._ends_word[ids]) + 1
        words = np.cumsum(1 + pc.match_substring(parted, " ").to_numpy(zero_copy_only=False))
        return (ids, stops[words - 1]) if len(stops) == words[-1] and stops[-1] == len(ids) else None

    def _marked(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(chunks) > 1:
            got = np.array(self._whole(f" {self.MARK} ".join([*chunks, ""])), self.dtype)
            marks = got == self._mark[0]
            return got[~marks], np.flatnonzero(marks) - np.arange(marks.sum())
        got = np.array(self._whole(chunks[0]), self.dtype)
        return got, np.array([len(got)])

    def _learn(self, chunks: list[str]) -> None:
        if not chunks:
            return
        every = pa.array(chunks)
        plain = pc.match_substring_regex(every, _PLAIN).to_numpy(zero_copy_only=False) & (self._bare is not None)
        names = np.array(chunks, object)
        ids, ends, order, total = [self._ids], [self._ends], [], len(self._ids)

        def add(made: tuple[np.ndarray, np.ndarray], of: list[str]) -> None:
            nonlocal total
            ids.append(made[0])
            ends.append(total + made[1])
            order.extend(of)
            total += len(made[0])

        fast, fast_names, rest = every.filter(pa.array(plain)), names[plain].tolist(), names[~plain].tolist()
        for at in range(0, len(fast), PIECES_AT_ONCE):
            made = self._pieces(fast.slice(at, PIECES_AT_ONCE))
            if made is None:
                rest += fast_names[at:at + PIECES_AT_ONCE]
            else:
                add(made, fast_names[at:at + PIECES_AT_ONCE])
        odd = [c for c in rest if self.MARK in c]
        rest = [c for c in rest if self.MARK not in c] if odd else rest
        for at in range(0, len(rest), 2_000):
            add(self._marked(rest[at:at + 2_000]), rest[at:at + 2_000])
        for chunk in odd:
            add(self._marked([chunk]), [chunk])
        first = len(self._numbers)
        self._numbers.update(zip(order, range(first, first + len(order))))
        self._ids, self._ends = np.concatenate(ids), np.concatenate(ends)

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of every text; null is empty."""
        texts = pc.fill_null(texts, "")
        if not self._split:
            return [np.array(self._whole(t), self.dtype) for t in texts.to_pylist()]
        if len(self._numbers) > MEMO_CHUNKS:
            self._keep_asked()
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        before = len(self._numbers)
        self._learn([c for c in distinct if c not in self._numbers])
        known = np.fromiter(map(self._numbers.__getitem__, distinct), np.int32, len(distinct))
        self._asked = np.concatenate([self._asked, np.zeros(len(self._numbers) - before, bool)])
        self._asked[known[known < before]] = True
        del distinct
        numbers = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int32)
        begins = self._ends[numbers].astype(np.int32)
        sizes = self._ends[numbers + 1].astype(np.int32) - begins
        stops = np.cumsum(sizes)
        shift = (begins + sizes - stops).astype(np.int32)
        flat = self._ids[np.arange(stops[-1] if len(stops) else 0, dtype=np.int32) + np.repeat(shift, sizes)]
        offsets = cut.offsets.to_numpy()
        cuts = np.concatenate([[0], stops])[offsets - offsets[0]]
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)):
            out[i] = np.array(self._whole(texts[i].as_py()), self.dtype)
        return out


def _by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``most`` bytes of a text column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


@lru_cache(maxsize=2)
def _encoder(data: bytes, splits_at_blanks: bool) -> ChunkEncoder:
    return ChunkEncoder(data, splits_at_blanks)


class _Writer:
    """Collects documents and writes them as files of one task."""

    def __init__(self, folder: str, partition: int, length: int, dtype, key: pa.DataType):
        self._store, self._folder = fs.FileSystem.from_uri(folder)
        self._prefix, self._length, self._dtype, self._key = f"part-{partition:06d}", length, dtype, key
        self._files, self.size = 0, 0
        self._ids: list[np.ndarray] = []
        self._keys: list = []

    def add(self, key, ids: np.ndarray) -> None:
        self._keys.append(key)
        self._ids.append(ids)
        self.size += len(ids)

    def close(self) -> tuple[str, int, int]:
        """Writes what was collected; (name, documents, ids)."""
        name = f"{self._prefix}-{self._files:06d}.arrow"
        ids = np.concatenate(self._ids)
        starts = np.cumsum([0, *map(len, self._ids)])[:-1]
        rows = -(-len(ids) // self._length)
        mask = np.arange(rows * self._length) < len(ids)
        padded = np.zeros(rows * self._length, self._dtype)
        padded[:len(ids)] = ids
        bounds = np.searchsorted(starts // self._length, np.arange(rows + 1)).astype(np.int32)
        documents = pa.StructArray.from_arrays([pa.array(self._keys, self._key),
                                                pa.array((starts % self._length).astype(np.int32))], ["doc_id", "at"])
        batch = pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(padded), self._length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self._length),
             pa.ListArray.from_arrays(pa.array(bounds), documents)], ["ids", "mask", "documents"])
        self._store.create_dir(self._folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        draft = f"{self._folder}/_{name}.{attempt}"
        with self._store.open_output_stream(draft) as sink, ipc.new_file(sink, batch.schema) as writer:
            writer.write_batch(batch)
        self._store.move(draft, f"{self._folder}/{name}")
        done = (name, len(self._keys), len(ids))
        self._files, self.size, self._ids, self._keys = self._files + 1, 0, [], []
        return done


def write_tokens(docs: DataFrame, folder: str, tokenizer: bytes, key: str = "doc_id", text: str = "text",
                 length: int = LENGTH, file_tokens: int = FILE_TOKENS, end_id: int = END_ID,
                 splits_at_blanks: bool = True) -> DataFrame:
    """Write all documents below ``folder`` (a URI) and return the manifest: name, documents, tokens, start.

    Rows are range-partitioned by key, so each task holds one stretch of the order. ``start`` counts the ids of all
    files before.
    """
    kind = pa.string() if dict(docs.dtypes)[key] == "string" else pa.int64()
    files = f"{folder}/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, splits_at_blanks)
        writer = _Writer(files, TaskContext.get().partitionId(), length, encoder.dtype, kind)
        done = []
        for part in _by_bytes(batches, 1):
            for one, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                writer.add(one, np.append(ids, np.array([end_id], encoder.dtype)))
                if writer.size >= file_tokens:
                    done.append(writer.close())
        if writer.size:
            done.append(writer.close())
        names, documents, tokens = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(documents, pa.int64()),
                                          pa.array(tokens, pa.int64())], ["name", "documents", "tokens"])

    ordered = docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    ordered.mapInArrow(write, "name string, documents long, tokens long").write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = docs.sparkSession.read.parquet(f"{folder}/manifest")
    total = running_total(manifest, [], ["name"], F.col("tokens"), "end_total")
    return total.withColumn("start", F.col("end_total") - F.col("tokens")).drop("end_total")


def open_sequences(path: str) -> ipc.RecordBatchFileReader:
    """A memory-mapped token file: sequences and masks are read without copying."""
    return ipc.open_file(pa.memory_map(path))


def _read_files(manifest: DataFrame, folder: str, schema: str, make) -> DataFrame:
    """A row for each document in the files of the manifest: ``make(keys, starts, id lists)`` gives batches."""
    files = f"{folder}/files"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(files)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    table = ipc.open_file(source).read_all().combine_chunks()
                length = table.schema.field("ids").type.list_size
                ids = table["ids"].chunk(0).values.to_numpy(zero_copy_only=True)
                valid = int(table["mask"].chunk(0).values.to_numpy(zero_copy_only=False).sum())
                held = table["documents"].chunk(0)
                row = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
                at = row * length + held.values.field("at").to_numpy()
                keys = held.values.field("doc_id")
                ends = np.append(at[1:], valid)
                for lo in range(0, len(at), 256):
                    hi = min(lo + 256, len(at))
                    yield make(keys.slice(lo, hi - lo), start + at[lo:hi], [ids[a:b] for a, b in zip(at[lo:hi], ends[lo:hi])])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "start").repartition(tasks, "name").mapInArrow(read, schema)


def read_documents(manifest: DataFrame, folder: str, key_type: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before), ids, from the files the manifest lists."""
    def make(keys, starts, ids):
        lists = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([keys, pa.array(starts), lists], ["doc_id", "start", "ids"])

    return _read_files(manifest, folder, f"doc_id {key_type}, start long, ids array<int>", make)


def read_digests(manifest: DataFrame, folder: str, key_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the files; their ids stay in the reading task."""
    def make(keys, starts, ids):
        sums = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array([len(x) for x in ids], pa.int64()), sums],
                                          ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read_files(manifest, folder, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long", make)
