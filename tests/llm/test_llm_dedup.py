"""SimHash, suffix arrays and decontamination against brute force, with awkward rows."""

import random

import pytest
from llm import brute
from pyspark.sql import functions as F

from docketflow.llm import components, decontam, queries, simhash, suffix

FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice("ab cd efg hij klmn opq rst uvw xyz of the an".split()) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(0, 60)) for _ in range(40)]
    long = prose(rng, 4000)
    near = [base[3] + f" tail{i}" for i in range(5)] + [long + " x", long + " y", long]
    return [*base, *base[:6], *near, "", None, "   \n\t", "one", "one two", "One TWO", "été À 中文"]


def test_simhash_groups(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = simhash.groups(frame(spark, rows, "doc_id long, text string, fp string, component int")).collect()
    prints, roots = brute.groups(texts)
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component"]) for r in got} == dict(enumerate(zip(prints, roots)))


def test_simhash_emission_is_dealt_to_all_tasks(spark):
    nodes = spark.range(5_000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    rows = simhash._variants(nodes, 3).groupBy(F.spark_partition_id().alias("p")).count().collect()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(rows) == tasks and max(r["count"] for r in rows) < 2 * sum(r["count"] for r in rows) / tasks


def test_simhash_bucket_over_many_batches(spark):
    """Buckets come in batches of 3 rows."""
    texts = [f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i % 40}" for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = simhash.groups(frame(spark, list(enumerate(texts)), "doc_id long, text string"), max_bits=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["doc_id"]: r["component"] for r in got} == dict(enumerate(brute.groups(texts, 2)[1]))


@pytest.mark.parametrize("bits", [0, 1, 2, 4])
def test_simhash_other_distances(spark, texts, bits):
    got = simhash.groups(frame(spark, list(enumerate(texts)), "doc_id long, text string"), max_bits=bits)
    assert {r["doc_id"]: r["component"] for r in got.collect()} == dict(enumerate(brute.groups(texts, bits)[1]))


def test_simhash_ball_meets_all_pairs(spark):
    """Planted distances around the limit, in a chain and in a crowd."""
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in prints[:10]:
        for d in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), d)))
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20, 40)]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    linked = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(nodes).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in linked)

    def roots(pairs):
        at = {p: p for p in prints}

        def root(x):
            while at[x] != x:
                x = at[x]
            return x
        for a, b in pairs:
            at[max(root(a), root(b))] = min(root(a), root(b))
        return [root(p) for p in prints]
    every = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    assert roots(linked) == roots(every) and len(linked) < len(prints) * 140


def test_simhash_large_buckets_look_neighbours_up(monkeypatch):
    import numpy as np
    rng = random.Random(2)
    fps = np.array(sorted({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}), np.uint64).astype(np.int64)
    small = simhash._forest(fps, 2)
    monkeypatch.setattr(simhash, "COMPARE_ALL", 10)
    monkeypatch.setattr(simhash, "ball", lambda mask, radius, real=simhash.ball: real(mask, radius)[:] if radius > 1 else real(mask, radius))
    large = simhash._forest(fps, 1), simhash._forest(fps, 2)
    assert len(large[1]) == len(small) and len(large[0]) <= len(small)


def test_simhash_null_ids_and_empty(spark):
    got = simhash.groups(frame(spark, [(None, "a b c d"), (None, "q r s t u v w"), (2, "a b c d"), (2, "a b c d")], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component"]) for r in got.collect() if r["doc_id"]) == [(2, 2), (2, 2)]
    assert sorted(str(r["component"]) for r in got.collect() if r["doc_id"] is None) == ["2", "None"]
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}


@pytest.mark.parametrize("shard_bytes", [10**6, 300])
@pytest.mark.parametrize("letters", ["abc \x00é", "ab"])
def test_suffix_removals(spark, letters, shard_bytes):
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [make(rng.randint(0, 120)) for _ in range(50)]
    rows = [*base, *base[:5], base[6][:50] + base[7][-60:] + base[6][:40], "a" * 77, "ab" * 50, "", None, make(5000),
            "ab" * 20 + "x" + "ab" * 30, *(base[9][:30] + make(3) + base[10][20:70] for _ in range(30))]
    df = frame(spark, [(i, t, "t", 0) for i, t in enumerate(rows)], "doc_id long, text string, tid string, low int")
    got = suffix.removals(df, length=20, gram=6, chunk_bytes=2_000, shard_bytes=shard_bytes)
    want = brute.removals(rows, 20)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == dict(enumerate(want))


def test_suffix_repeated_rows_and_empty(spark):
    rows = [(None, "x" * 30), (1, "abcdefghijklmnopqrstuvwxyz"), (1, "abcdefghijklmnopqrstuvwxyz"), (1, "short")]
    got = suffix.removals(frame(spark, rows, "doc_id long, text string"), length=20, gram=6).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 0), ("1", 26), ("1", 26), ("None", 30)]
    assert suffix.removals(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order_is_sorted():
    import numpy as np
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    sizes = np.array([len(p) for p in parts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    data = b"".join(parts)
    order, rank = suffix.suffix_order(np.frombuffer(data, np.uint8), ends)
    cut = [data[i:ends[i]] for i in order]
    assert cut == sorted(cut) and (rank[order] == np.arange(len(data))).all()
    shared = suffix.common_prefixes(np.frombuffer(data, np.uint8), order, rank, np.cumsum(sizes) - sizes, sizes, ends, 25)
    for i in range(1, len(order)):
        a, b = cut[i - 1], cut[i]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[order[i]] == min(25, same)


def test_suffix_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d["doc_id"] for d in docs], brute.removals([d["text"] for d in docs], 400)))
    got = queries.op7(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


@pytest.mark.parametrize("max_broadcast", [10**6, 3])
def test_decontamination(spark, max_broadcast):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(0, 30))) for i in range(12)] + [(77, "A b, C"), (78, None), (79, "..."), (80, "a b c")]
    docs = [prose(rng, 10) + " " + (items[i % 12][1] or "") + " " + prose(rng, 12) for i in range(20)]
    docs += ["x A-b c y a b c a b c", None, "", prose(rng, 3000) + " " + items[0][1], "a b c"]
    df = frame(spark, [(i, t, 1, "z") for i, t in enumerate(docs)], "doc_id long, text string, n_hit int, pos string")
    got = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"), max_broadcast=max_broadcast).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(brute.contamination(docs, items)))


def test_decontamination_repeated_ids_and_no_items(spark):
    rows = [(1, "k a b c"), (1, "k a b c"), (1, None), (None, "a b c"), (1, "other")]
    df, items = frame(spark, rows, "doc_id long, text string"), spark.createDataFrame([(4, "a b c")], "item_id long, text string")
    got = decontam.contamination(df, items).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in got) == [("1", 0, 0), ("1", 1, 0), ("1", 4, 3), ("1", 4, 3), ("None", 3, 3)]
    assert {r["n_hit"] for r in decontam.contamination(df, items.limit(0)).collect()} == {0}
    assert decontam.contamination(df.limit(0), items).count() == 0
