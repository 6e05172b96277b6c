"""Hidden Markov language model over words, trained by Baum-Welch across partitions.

A text is its words (A-Z lower-cased, cut at ASCII white space) and one end. The hidden states emit word classes, and a
class emits its words:

    P(word | state) = P(class | state) * (c + 1) / (N_class + V_class + 1)

with c the word's count in the training tokens, N and V the tokens and distinct words of its class; the +1 leaves each
class room for one unknown word, so the probabilities of all texts sum to one. A word's class is a hash of the word, one
of CLASSES; the end has a class of its own. That makes the trained part (start, transitions, classes by state) equally
large for every corpus, and it may be broadcast. Word counts, which grow with the corpus, never are: they stay in tables.

Steps, each over all rows:

1. `blocks`: every task cuts its texts and numbers the words within blocks of BLOCK_CHARS characters; token numbers,
   distinct words and training counts of a block form one row, written once to the shared folder.
2. `word_counts`: the training counts of all blocks, summed by word.
3. `train`: in each round every block runs the scaled forward-backward recursion over its training texts, all texts of a
   block in step; expected counts are added up within the task, then across tasks by slices of classes.
4. `score`: blocks meet the counts of their own words, and the scaled forward recursion gives each text's exact
   probability under the model.

Null texts are empty ones: a single end. Null ids are training rows. Repeated ids keep one row each. With no training
rows all words are unknown and the states keep their initial, class-wise uniform emissions.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.rows import slices
from docketflow.session import scratch_path

CLASSES = 1 << 16
STATES = 8
ROUNDS = 4
BLOCK_CHARS = 12_000_000
#: Pseudo-tokens that pull the states' shares of a class to their overall shares, and pseudo-counts of every transition.
CLASS_PRIOR, MOVE_PRIOR = 8.0, 1.0
#: Tokens' worth of room that every class has for unknown words.
UNKNOWN_SHARE = 0.5
CLASS_SLICE = 1_024
#: Tasks whose sums are added up together before the shares are.
TASKS_A_SHARE = 256

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_END = b" "


class _Vocabulary(dict):
    """Numbers words in the order they are met; the end is 0."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _block(keys: list, held: list, texts: list[np.ndarray], vocabulary: _Vocabulary) -> tuple:
    sizes = np.array([len(t) for t in texts], np.int32)
    tokens = np.concatenate(texts)
    train = np.bincount(tokens[np.repeat(~np.array(held, bool), sizes)], minlength=len(vocabulary))
    words = list(vocabulary)
    classes = np.array([CLASSES, *(zlib.crc32(w) % CLASSES for w in words[1:])], "<i4")
    return keys, held, sizes.tolist(), _planes(tokens), words, classes.tobytes(), train.astype(np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers with all lowest bytes first: the other planes are mostly zero, so files and shuffles shrink."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def blocks(docs: DataFrame, held: str, key: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of texts; see the module's text."""
    kind = dict(docs.dtypes)[key]
    names = ["block", "keys", "held", "sizes", "tokens", "words", "classes", "train"]
    types = [pa.int64(), pa.list_(pa.string() if kind == "string" else pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()),
             pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        keys, marks, texts, chars, vocabulary = [], [], [], 0, _Vocabulary({_END: 0})

        def flush():
            row = (part << 32 | made, *_block(keys, marks, texts, vocabulary))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in slices(batches, 256):
            for one, mark, given in zip(*(c.to_pylist() for c in batch.columns)):
                data = (given or "").encode("utf-8", "replace").translate(_LOWER)
                words = data.split()
                texts.append(np.fromiter([*map(vocabulary.__getitem__, words), 0], np.int32, len(words) + 1))
                keys.append(one)
                marks.append(bool(mark))
                chars += len(data)
                if chars >= block_chars:
                    yield flush()
                    made += 1
                    keys, marks, texts, chars, vocabulary = [], [], [], 0, _Vocabulary({_END: 0})
        if keys:
            yield flush()

    schema = f"block long, keys array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, words array<binary>, " \
        "classes binary, train array<bigint>"
    return docs.select(key, held, text).mapInArrow(cut, schema)


def word_counts(made: DataFrame) -> DataFrame:
    """word, c: training tokens of every word (the end is a single blank)."""
    each = made.select(F.explode(F.arrays_zip("words", "train")).alias("x")).select("x.words", "x.train").where(F.col("train") > 0)
    return each.groupBy(F.col("words").alias("word")).agg(F.sum("train").alias("c"))


@dataclass
class Model:
    """Start, transitions and class emissions by state; tokens and distinct words by class."""

    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def mass(self) -> np.ndarray:
        """What each class weighs: its tokens, one for each distinct word, and a share for unknown words."""
        return self.class_tokens + self.class_words + UNKNOWN_SHARE

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum())

    @property
    def words(self) -> int:
        return int(self.class_words.sum())


def initial(class_tokens: np.ndarray, class_words: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
    """States that stay put and differ by random tilts of the corpus-wide class shares."""
    rng = np.random.default_rng(seed)
    moves = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    model = Model(np.full(states, 1 / states), moves, np.zeros(0), class_tokens, class_words)
    emit = model.mass[:, None] * np.exp(rng.normal(0, 0.5, (len(class_tokens), states)))
    model.emit = emit / emit.sum(0)
    return model


class _Steps:
    """Texts of a block in step: longest first, tokens ordered by position, then text."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        ranked = sizes[self.order]
        longest = int(ranked[0]) if len(ranked) else 0
        self.width = len(ranked) - np.searchsorted(ranked[::-1], np.arange(longest), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][self.order]
        text = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.width)
        self.take = starts[text] + np.repeat(np.arange(longest), self.width)


def forward(model: Model, classes: np.ndarray, steps: _Steps, keep: bool = False, dtype=np.float64):
    """Log probability (natural) of each text, in the order of ``steps``; with ``keep`` also scaled alphas and scales."""
    emit, moves = model.emit.astype(dtype), model.moves.astype(dtype)
    total = np.zeros(len(steps.order))
    alphas = np.empty((len(classes), emit.shape[1]), dtype) if keep else None
    scales = np.empty(len(classes), dtype) if keep else None
    alpha = None
    for t, n in enumerate(steps.width):
        seen = emit[classes[steps.at[t]:steps.at[t + 1]]]
        alpha = seen * model.start.astype(dtype) if t == 0 else (alpha[:n] @ moves) * seen
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
        if keep:
            alphas[steps.at[t]:steps.at[t + 1]] = alpha
            scales[steps.at[t]:steps.at[t + 1]] = scale
    return (total, alphas, scales) if keep else total


def expected(model: Model, classes: np.ndarray, steps: _Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of one block: starts, transitions, class emissions; and the log probability."""
    states = len(model.start)
    total, gammas, scales = forward(model, classes, steps, keep=True, dtype=np.float32)
    emit, moves = model.emit.astype(np.float32), model.moves.astype(np.float32)
    move_sum = np.zeros((states, states))
    beta = None
    for t in range(len(steps.width) - 1, -1, -1):
        a, b = steps.at[t], steps.at[t + 1]
        alpha = gammas[a:b]
        now = np.ones((b - a, states), np.float32)
        if beta is not None:
            c, d = b, steps.at[t + 2]
            ahead = emit[classes[c:d]] * beta / scales[c:d, None]
            now[:d - c] = ahead @ moves.T
            move_sum += alpha[:d - c].T @ ahead
        beta = now
        gammas[a:b] = alpha * now
    gammas /= gammas.sum(1, keepdims=True)
    starts = gammas[:len(steps.order)].sum(0, dtype=np.float64)
    counts = np.stack([np.bincount(classes, gammas[:, k], CLASSES + 1) for k in range(states)], 1)
    return starts, move_sum * model.moves, counts, float(total.sum())


def improved(model: Model, starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> Model:
    """The model that the expected counts give.

    A rare class says little about its state, so its counts are shrunk to the states' overall shares; without that the
    states learn single texts by heart.
    """
    overall = emissions.sum(0) / max(1e-9, emissions.sum())
    emit = (emissions + CLASS_PRIOR * overall) / (emissions.sum(1, keepdims=True) + CLASS_PRIOR)
    emit *= model.mass[:, None]
    start, move = starts + MOVE_PRIOR, moves + MOVE_PRIOR
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), model.class_tokens, model.class_words)


def _unpacked(row: dict, train_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(local word numbers, sizes, which texts) of a block row."""
    sizes, tokens = np.array(row["sizes"], np.int64), _numbers(row["tokens"])
    if not train_only:
        return tokens, sizes, np.ones(len(sizes), bool)
    chosen = ~np.array(row["held"], bool)
    return tokens[np.repeat(chosen, sizes)], sizes[chosen], chosen


def _round(made: DataFrame, model: Model) -> tuple[Model, float]:
    """One Baum-Welch round over all blocks."""
    spark = made.sparkSession
    states = len(model.start)
    sent = spark.sparkContext.broadcast(model)  # fixed size: CLASSES x states numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, emissions, total = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 1, states)), 0.0
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            tokens, sizes, _ = _unpacked(row, train_only=True)
            if len(sizes):
                steps = _Steps(sizes)
                got = expected(sent.value, np.frombuffer(row["classes"], "<i4")[tokens[steps.take]], steps)
                starts, moves, emissions, total = starts + got[0], moves + got[1], emissions + got[2], total + got[3]
        share = (TaskContext.get().partitionId() if TaskContext.get() else 0) // TASKS_A_SHARE
        parts = [(-1, np.concatenate([[total], starts, moves.ravel()]))]
        parts += [(at // CLASS_SLICE, emissions[at:at + CLASS_SLICE].ravel()) for at in range(0, CLASSES + 1, CLASS_SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array([share] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()),
                                          pa.array([p[1].astype("<f8" if p[0] < 0 else "<f4").tobytes() for p in parts], pa.binary())],
                                         names=["share", "part", "counts"])

    def adding(narrow: bool):
        def add(group: pd.DataFrame) -> pd.DataFrame:
            part = int(group["part"].iloc[0])
            total = sum(np.frombuffer(x, "<f4" if narrow and part >= 0 else "<f8").astype(float) for x in group["counts"])
            return pd.DataFrame({"part": [part], "counts": [np.asarray(total).astype("<f8").tobytes()]})
        return add

    # In two levels, so that no task adds up one row from every task there was.
    shares = made.select("held", "sizes", "tokens", "classes").mapInArrow(count, "share int, part int, counts binary") \
        .groupBy("share", "part").applyInPandas(adding(narrow=True), "part int, counts binary")
    rows = shares.groupBy("part").applyInPandas(adding(narrow=False), "part int, counts binary").collect()
    sums = {r["part"]: np.frombuffer(r["counts"], "<f8") for r in rows}
    sent.destroy()
    head = sums.get(-1, np.zeros(1 + states + states * states))
    emissions = np.concatenate([sums.get(i, np.zeros(0)) for i in range(-(-(CLASSES + 1) // CLASS_SLICE))])
    emissions = emissions.reshape(-1, states) if len(emissions) else np.zeros((CLASSES + 1, states))
    return improved(model, head[1:1 + states], head[1 + states:].reshape(states, states), emissions), float(head[0])


def train(made: DataFrame, counts: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the training texts of all blocks."""
    by_class = counts.where(F.col("word") != F.lit(_END)).groupBy((F.crc32("word") % CLASSES).cast("int").alias("class")) \
        .agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tokens, words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in by_class:
        tokens[r["class"]], words[r["class"]] = r["n"], r["v"]
    ends = counts.where(F.col("word") == F.lit(_END)).agg(F.sum("c")).first()[0]
    tokens[CLASSES], words[CLASSES] = ends or 0, int(bool(ends))
    model = initial(tokens, words, states)
    for _ in range(rounds if ends else 0):
        model, _ = _round(made, model)
    return model


def _scored(model: Model, row: dict, counts: np.ndarray) -> tuple:
    """Per text of a block: tokens, known tokens, base score, score."""
    tokens, sizes, _ = _unpacked(row, train_only=False)
    classes = np.frombuffer(row["classes"], "<i4")
    within = np.log10((counts + 1) / (model.class_tokens[classes] + model.class_words[classes] + 1))
    within[0] = 0.0
    base = np.log10((counts + 1) / (model.tokens + model.words + 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    steps = _Steps(sizes)
    hidden = np.zeros(len(sizes))
    hidden[steps.order] = forward(model, classes[tokens[steps.take]], steps) / np.log(10)
    add = lambda x: np.add.reduceat(x[tokens], starts)
    return sizes, add((counts > 0).astype(np.int64)), add(base), hidden + add(within)


def score(made: DataFrame, counts: DataFrame, model: Model, key: str) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = made.sparkSession
    kind = dict(made.dtypes)["keys"][6:-1]
    own = made.select("block", F.posexplode("words").alias("at", "word")).join(counts, "word") \
        .groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"))
    full = made.select("block", "keys", "held", "sizes", "tokens", "classes").join(own, "block", "left")
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys, held = batch.column(1).flatten(), batch.column(2).flatten()
            row = {n: batch.column(n)[0].as_py() for n in ("sizes", "tokens", "classes")}
            known = np.zeros(len(row["classes"]) // 4)
            known[batch.column("at").flatten().to_numpy()] = batch.column("c").flatten().to_numpy()
            sizes, seen, base, total = _scored(sent.value, row, known)
            yield pa.RecordBatch.from_arrays(
                [keys, held, pa.array(sizes), pa.array(seen), pa.array(np.full(len(sizes), sent.value.tokens)),
                 pa.array(base), pa.array(total)], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return full.mapInArrow(work, f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double")


def model_scores(docs: DataFrame, held: str, key: str = "doc_id", text: str = "text", states: int = STATES,
                 rounds: int = ROUNDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Train on the rows that ``held`` (a boolean column) does not mark, and score all rows."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "hmm")
    blocks(docs, held, key, text, block_chars).write.option("compression", "zstd").parquet(os.path.join(folder, "blocks"))
    made = spark.read.parquet(os.path.join(folder, "blocks"))
    word_counts(made).write.parquet(os.path.join(folder, "counts"))
    counts = spark.read.parquet(os.path.join(folder, "counts"))
    return score(made, counts, train(made, counts, states, rounds), key)
