"""Language model, classifier and nearest neighbours."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from docketflow.llm import ann, hmm, quality, queries


def test_forward_is_exact():
    """The recursion against the sum over all state paths, on texts of unequal length."""
    rng = np.random.default_rng(1)
    tokens, words = np.zeros(hmm.CLASSES + 1), np.zeros(hmm.CLASSES + 1)
    model = hmm.initial(tokens, words, 3)
    model.moves = rng.dirichlet(np.ones(3), 3)
    model.start = rng.dirichlet(np.ones(3))
    sizes = np.array([2, 5, 1, 3])
    classes = rng.integers(0, hmm.CLASSES, sizes.sum())
    steps = hmm._Steps(sizes)
    got = np.empty(4)
    got[steps.order] = hmm.forward(model, classes[steps.take], steps)
    for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        total = sum(model.start[p[0]] * math.prod(model.moves[x, y] for x, y in zip(p, p[1:]))
                    * math.prod(model.emit[c, s] for c, s in zip(classes[a:a + n], p)) for p in itertools.product(range(3), repeat=int(n)))
        assert got[i] == pytest.approx(math.log(total))


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(2)
    sizes = rng.integers(5, 40, 60)
    sides = np.repeat(rng.integers(0, 2, 60), sizes)
    classes = rng.integers(0, 50, sizes.sum()) + 50 * sides
    counts = np.bincount(classes, minlength=hmm.CLASSES + 1).astype(float)
    model, steps, seen = hmm.initial(counts, counts > 0, 2), hmm._Steps(sizes), []
    for _ in range(6):
        starts, moves, emissions, total = hmm.expected(model, classes[steps.take], steps)
        assert starts.sum() == pytest.approx(60, rel=1e-4) and emissions.sum() == pytest.approx(sizes.sum(), rel=1e-4)
        assert moves.sum() == pytest.approx(sizes.sum() - 60, rel=1e-4)
        model = hmm.improved(model, starts, moves, emissions)
        seen.append(total)
    assert seen[-1] > seen[0] and np.allclose(model.emit.sum(0), 1) and np.allclose(model.moves.sum(1), 1)


@pytest.mark.parametrize("block_chars", [300, 10**6])
def test_model_scores_base(spark, block_chars):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d e f Gg hh".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "one two \x0bthree", "zz " * 9000, *texts[:3]]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    got = {r["doc_id"]: r for r in hmm.model_scores(df.repartition(4), "held", block_chars=block_chars).collect()}
    for i, (held, n, known, total, base) in enumerate(brute.base_scores(range(len(texts)), texts)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert got[0]["score"] == pytest.approx(got[64]["score"]) if texts[0] == texts[64] else True


def test_model_probabilities_sum_to_one():
    """Within a class the known words and one unknown word share all probability."""
    counts = np.array([4.0, 1.0, 2.0])
    assert ((counts + 1).sum() + 1) / (counts.sum() + len(counts) + 1) == pytest.approx(1)


def test_model_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", True), (None, None, True)], "doc_id long, text string, held boolean")
    got = hmm.model_scores(df, "held").collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)} and all(r["score"] < 0 for r in got)
    assert hmm.model_scores(df.limit(0), "held").count() == 0


def test_model_beats_its_base(spark):
    got = [r for r in queries.op3(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_model_is_trained_in_four_rounds(spark):
    df = spark.createDataFrame([(i, f"a b {'c d' if i % 3 else 'e f g'} {i % 7}", i % 5 == 0) for i in range(60)],
                               "doc_id long, text string, held boolean")
    default, three, four = ({r["doc_id"]: r["score"] for r in hmm.model_scores(df, "held", **given).collect()}
                            for given in ({}, {"rounds": 3}, {"rounds": 4}))
    assert default == pytest.approx(four, rel=1e-9) and default != pytest.approx(three, rel=1e-9)


def test_machine_uses_the_sum_of_squares():
    rng = np.random.default_rng(1)
    size = quality.WORD_BUCKETS + quality.N_STATS * quality.BINS
    machine = quality.Machine(np.zeros((quality.N_STATS, quality.BINS - 1)), 0.3, rng.normal(size=size), rng.normal(size=(size, 4)), True)
    ids, values, ends = machine.rows(["One two, THREE two", ""])
    for i, (a, b) in enumerate(zip([0, ends[0]], ends)):
        pairs = sum(machine.factors[ids[p]] @ machine.factors[ids[q]] * values[p] * values[q] for p in range(a, b) for q in range(a, p))
        want = 0.3 + machine.linear[ids[a:b]] @ values[a:b] + pairs
        assert machine.raw(ids, values, ends)[i] == pytest.approx(want)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op8(spark, folder).collect()}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if brute.fold(r["doc_id"]) % 4 == 2]
    assert all(r["held_out"] == (brute.fold(k) % 4 == 2) for k, r in got.items())
    assert sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels) >= 0.95 * len(labels)


def test_quality_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (1, "", 2.0), (None, "a b", 3.0), (2, "word " * 200_000, 4.0), (3, "| | |", 5.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (2, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    got = quality.classify(docs, machine).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    empty = quality.fit(docs, labels.limit(0))
    assert not empty.fitted and {r["score"] for r in quality.classify(docs, empty).collect()} == {0.5}
    assert quality.classify(docs.limit(0), machine).count() == 0


def test_fit_is_bounded_and_ignores_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    good = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    bad = good.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 0).otherwise(1))
    a, b = quality.fit(docs, good, max_rows=50), quality.fit(docs, bad, max_rows=50)
    assert np.array_equal(a.linear, b.linear) and a.bias == b.bias


def cells(dims, bits):
    return np.array(list(itertools.product(range(1 << bits), repeat=dims))).T


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_walks_to_neighbours(dims, bits):
    points = cells(dims, bits)
    places = ann.hilbert(points, bits)
    assert sorted(places) == list(range(points.shape[1]))
    walk = points[:, np.argsort(places)]
    assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all()


def test_nearest_with_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 6))
    vectors[30:] = vectors[3]
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)]
    rows += [(100, None, 0), (101, [0.0] * 6, 0), (102, [float("nan")] * 6, 0), (103, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0),
             (104, [1.0, 2.0], 0), (105, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (106, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = ann.search(df, F.col("id") % 3 == 0, k=4, orderings=4, window=50).collect()
    want = brute.nearest(list(range(40)), vectors, 4)
    for q in range(0, 40, 3):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(i, v) for i, v, _ in mine] == [(i + 1, v) for i, (v, _) in enumerate(want[q])]
        assert [s for *_, s in mine] == pytest.approx([s for _, s in want[q]])
    assert {r["query_id"] for r in got} == set(range(0, 40, 3))
    assert ann.search(df.limit(0), F.col("id") % 3 == 0).count() == 0
    few = ann.search(df.where("vec_id in (1, 2)"), F.col("id") > 0, k=4).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(1, 1, 2), (2, 1, 1)]


def test_recall(spark):
    """Narrow windows, so that not all rows are met."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    got = ann.search(rows, F.col("id") % 50 == 0, window=64, orderings=24).collect()
    table = sorted(rows.collect())
    want = brute.nearest([r[0] for r in table], np.array([r[1] for r in table], float), 5)
    found = {q: set() for q in want}
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    hits = [len(found[q] & {v for v, _ in want[q]}) / 5 for q in want if q % 50 == 0]
    full = queries.op1(spark, folder).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    recall = np.mean([len(set(r["v"]) & {v for v, _ in want[r["query_id"]]}) / 5 for r in full])
    assert recall >= 0.9 and np.mean(hits) >= 0.7


def test_reach_grows_with_the_table(spark):
    """A table that is large beside its windows: with a fixed number of orderings most neighbours were lost."""
    assert ann.orderings_for(50_000) == ann.ORDERINGS and ann.orderings_for(4_000_000) >= 1.9 * ann.orderings_for(1_000_000)
    vectors = np.random.default_rng(7).normal(size=(6_000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") % 200 == 0, window=24).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit[::200] @ unit.T
    scores[np.arange(30), np.arange(0, 6_000, 200)] = -1
    want = {(200 * q, v) for q, row in enumerate(np.argsort(-scores, axis=1)[:, :5]) for v in row}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


def test_folds_agree(spark):
    rows = spark.range(200).select(F.crc32(F.col("id").cast("string")).alias("c"), "id").collect()
    assert all(r["c"] == zlib.crc32(str(r["id"]).encode()) for r in rows)
