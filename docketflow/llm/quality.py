"""Quality classifier: a factorisation machine over hashed words, text structure and length.

A text becomes a sparse row: its distinct lower-cased words hashed to WORD_BUCKETS with damped, normalised counts, and
one active feature for each structure statistic, the quantile bin it falls in. The machine scores

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which is linear in the active features. It is fitted on at most ``max_rows`` labelled rows, those with the smallest hash
of their id, so the choice spreads over all files and does not depend on their order; everything is scored.

Null texts are scored like empty ones. Rows without a label, labels without a row and null labels are left out of the
fit; a row that is labelled twice counts twice. Without any labelled row the model is not ``fitted`` and scores 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BUCKETS = 1 << 14
BINS = 16
FACTORS = 8
MAX_TRAIN_ROWS = 6_000
EPOCHS = 12
THRESHOLD = 0.7

_CLASSES = np.full(256, 7, np.uint8)
for _code in range(128):
    _char = chr(_code)
    _CLASSES[_code] = 0 if _char.islower() else 1 if _char.isupper() else 2 if _char.isdigit() else 3 if _char in "\n\r" \
        else 4 if _char.isspace() else 5 if _char in ".,;:'\"-?()" else 6


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure and length of a text, each a number that does not depend on its language."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(_CLASSES[data], minlength=8) / max(1, len(data))
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = share[0] + share[1] + share[7]
    return [*share, np.log1p(len(words)), np.log1p(len(text)), (len(text) - len(words)) / n, len(counts) / n,
            max(counts.values(), default=0) / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
            np.log1p(len(words) / max(1, len(lines))), share[1] / max(1e-9, letters),
            sum(not w[-1].isalnum() for w in words) / n]


N_STATS = 18


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(word buckets, their values, statistics) of a text."""
    text = text or ""
    words = text.split()
    counts = Counter(text.lower().split())
    buckets = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS for w in counts), np.int64, len(counts))
    buckets, place = np.unique(buckets, return_inverse=True)
    values = np.log1p(np.bincount(place, np.fromiter(counts.values(), float, len(counts)), len(buckets)))
    return buckets, values / max(1e-9, float(np.sqrt((values ** 2).sum()))), statistics(text, words, counts)


@dataclass
class Machine:
    """Weights of a factorisation machine and the bin edges of its statistics."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    fitted: bool

    def rows(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and row ends of some texts."""
        return self.assemble([features(t) for t in texts])

    def assemble(self, made) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stats = np.array([m[2] for m in made]).reshape(len(made), N_STATS)
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(N_STATS)], 1)
        active = WORD_BUCKETS + np.arange(N_STATS) * BINS + bins
        ids = [np.concatenate([m[0], a]) for m, a in zip(made, active)]
        values = [np.concatenate([m[1], np.full(N_STATS, 1 / np.sqrt(N_STATS))]) for m in made]
        return np.concatenate(ids), np.concatenate(values), np.cumsum([len(x) for x in ids])

    def score(self, texts) -> np.ndarray:
        if len(texts) == 0:
            return np.zeros(0)
        if not self.fitted:
            return np.full(len(texts), 0.5)
        return _sigmoid(self.raw(*self.rows(texts)))

    def raw(self, ids: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], ends[:-1]])
        weighted = self.factors[ids] * values[:, None]
        sums, squares = np.add.reduceat(weighted, starts), np.add.reduceat(weighted ** 2, starts)
        return self.bias + np.add.reduceat(self.linear[ids] * values, starts) + 0.5 * (sums ** 2 - squares).sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(made: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, epochs: int = EPOCHS,
          rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fit on the features of some texts by AdaGrad on the logistic loss."""
    size = WORD_BUCKETS + N_STATS * BINS
    rng = np.random.default_rng(seed)
    machine = Machine(np.zeros((N_STATS, BINS - 1)), 0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), len(made) > 0)
    if not machine.fitted:
        return machine
    stats = np.array([m[2] for m in made])
    machine.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy()
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), 64):
            chosen = order[at:at + 64]
            ids, values, ends = machine.assemble([made[i] for i in chosen])
            error = _sigmoid(machine.raw(ids, values, ends)) - labels[chosen]
            sizes = np.diff(np.concatenate([[0], ends]))
            each = np.repeat(error, sizes)
            weighted = machine.factors[ids] * values[:, None]
            sums = np.repeat(np.add.reduceat(weighted, ends - sizes), sizes, axis=0)
            unique, place = np.unique(ids, return_inverse=True)
            grad_w, grad_v = np.zeros(len(unique)), np.zeros((len(unique), FACTORS))
            np.add.at(grad_w, place, each * values)
            np.add.at(grad_v, place, (each * values)[:, None] * (sums - weighted))
            grad_w = grad_w / len(chosen) + decay * machine.linear[unique]
            grad_v = grad_v / len(chosen) + decay * machine.factors[unique]
            seen_w[unique] += grad_w ** 2
            seen_v[unique] += grad_v ** 2
            seen_b += error.mean() ** 2
            machine.linear[unique] -= rate * grad_w / np.sqrt(seen_w[unique])
            machine.factors[unique] -= rate * grad_v / np.sqrt(seen_v[unique])
            machine.bias -= rate * error.mean() / np.sqrt(seen_b)
    return machine


def held_out(key: Column, modulus: int = 4, fold: int = 2) -> Column:
    """True for the rows no label may be learnt from; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        max_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold."""
    chosen = labels.select(F.col(key).alias("l_key"), F.col(label).cast("int").alias("l_label")) \
        .where(F.col("l_label").isNotNull() & F.col("l_key").isNotNull() & ~held_out(F.col("l_key"))) \
        .orderBy(F.xxhash64("l_key"), "l_key", "l_label").limit(max_rows)
    given = docs.select(F.col(key).alias("d_key"), F.col(text).alias("d_text"))
    # At most max_rows rows of two numbers: small by construction.
    picked = given.join(F.broadcast(chosen), F.col("d_key") == F.col("l_key")) \
        .select(_features_of(F.col("d_text")).alias("x"), "l_label", "d_key").orderBy("d_key", "l_label").limit(max_rows).collect()
    made = [(np.frombuffer(r["x"]["ids"], "<i4").astype(np.int64), np.frombuffer(r["x"]["weights"], "<f4").astype(float),
             list(r["x"]["stats"])) for r in picked]
    return train(made, np.array([r["l_label"] for r in picked], float))


def _features_of(text: Column) -> Column:
    """Features as a column, packed: at most WORD_BUCKETS numbers a text, however long it is."""
    def work(texts: pd.Series) -> pd.DataFrame:
        made = [features(t) for t in texts]
        return pd.DataFrame({"ids": [m[0].astype("<i4").tobytes() for m in made],
                             "weights": [m[1].astype("<f4").tobytes() for m in made], "stats": [m[2] for m in made]})
    return F.pandas_udf(work, "ids binary, weights binary, stats array<double>")(text)


def score(text: Column, machine: Machine) -> Column:
    """The machine's score of a text column, 0 to 1."""
    def work(texts: pd.Series) -> pd.Series:
        parts = [machine.score(list(texts.iloc[at:at + 512])) for at in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))
    return F.pandas_udf(work, "double")(text)


def classify(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted of every row."""
    return docs.select(key, held_out(F.col(key)).alias("held_out"), score(F.col(text), machine).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
