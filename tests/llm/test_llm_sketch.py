"""Sketches: subtraction and peeling against plain sets, and the order of versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketflow.llm import queries, sketch

FOLDER = "/root/testdata/sf0.001"


def ids(seed, n):
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64)


def test_differences_equal_sets():
    rng = random.Random(3)
    pairs = []
    for i in range(120):
        shared, a, b = ids(3 * i, rng.choice([0, 1, 50, 900])), ids(3 * i + 1, rng.choice([0, 1, 4, 70])), ids(3 * i + 2, rng.choice([0, 2, 9, 300]))
        pairs.append((np.concatenate([shared, a]), np.concatenate([b, shared])))
    for (a, b), (left, right) in zip(pairs, sketch.differences([p[0] for p in pairs], [p[1] for p in pairs])):
        assert set(left) == set(a) - set(b) and set(right) == set(b) - set(a)
        assert len(left) == len(set(left)) and len(right) == len(set(right))


def test_chunks_and_digests_that_never_peel(monkeypatch):
    monkeypatch.setattr(sketch, "CELLS_AT_ONCE", 100)
    a, b = ids(1, 400), ids(2, 300)
    (left, right), (none, _) = sketch.differences([a, a], [b, a])
    assert set(left) == set(a) and set(right) == set(b) and len(none) == 0
    twice = np.concatenate([a, a[:1]])   # equal digests cancel each other's check; compared directly in the end
    (left, _), = sketch.differences([twice], [a[1:]])
    assert set(left) == {a[0]}


def test_sketches_subtract_across_strings():
    paragraphs = sketch.Paragraphs()
    one, two = paragraphs.digests("first line\nsecond line here\nthird"), paragraphs.digests("first line\nanother line here\nthird")
    packed = [sketch.Sketches.from_string(s) for s in sketch.Sketches.of([one, two], sketch.CELLS).to_strings()]
    emptied, digests, _, side = (packed[0] - packed[1]).peel()
    assert emptied.all() and set(digests[side > 0]) == set(one) - set(two) and set(digests[side < 0]) == set(two) - set(one)


def test_paragraphs():
    paragraphs = sketch.Paragraphs(stretch=1 << 40)
    assert len(paragraphs.digests("")) == 0 and len(paragraphs.digests(" ")) == 1
    lines = paragraphs.digests("same\nsame\nsame\nother words of a line\n")
    assert len(lines) == len(set(lines)) == 4
    assert set(paragraphs.digests("same\nsame\n")) < set(lines)
    assert set(paragraphs.digests("other words of a line\nsame\nsame\nsame\n")) == set(lines)
    fine = sketch.Paragraphs()
    text = " ".join(str(i) for i in range(4_000))
    changed = text.replace(" 2000 ", " two thousand ")
    found = sketch.differences([fine.digests(text)], [fine.digests(changed)])[0]
    assert 0 < sum(map(len, found)) < 30 and 500 < len(fine.digests(text)) < 2_000


def test_long_texts_are_cut_alike(monkeypatch):
    text = "some words of a text\nand more of them " * 3_000
    whole = sketch.Paragraphs().digests(text)
    monkeypatch.setattr(sketch, "LONG_TEXT", 10)
    monkeypatch.setattr(sketch, "MEMO_WORDS", 3)
    assert (sketch.Paragraphs().digests(text) == whole).all()


def plain_versions(rows, cells=sketch.CELLS):
    """By sorting everything in one place and comparing sets; rows are (key, text)."""
    out, paragraphs = [], sketch.Paragraphs()
    texts = [t or "" for _, t in rows]
    for i, (key, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(rows)]
        size = len(text) // 4
        changed = text[:len(text) - size] + following[:size]
        sets = [set(paragraphs.digests(t).tolist()) for t in (text, changed, following)]
        near = [1 - len(sets[0] ^ s) / (len(sets[0]) + len(s)) if sets[0] or s else 1.0 for s in sets[1:]]
        marks = [sketch.Sketches.of([paragraphs.digests(t)], cells).to_strings()[0] for t in (text, changed)]
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), *marks, *near, len(sets[0])))
    return out


def text_of(row):
    return [tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in row]


@pytest.mark.parametrize("parts", [1, 7])
def test_versions_in_order(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 7 % 601 - 50, "".join(rng.choice(["a ", "bb ", "c\n", "é. ", "\U0001f600"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows[5], rows[6] = (rows[5][0], None), (rows[6][0], "x " * 60_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, fingerprint string").repartition(5)
        got = sketch.versions(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert text_of(sorted(tuple(r) for r in got)) == text_of(sorted(plain_versions(sorted(rows, key=lambda r: r[0]))))


def test_repeated_rows_null_ids_and_small_tables(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a\nb"), (3, "same\ntext"), (3, "same\ntext"), (3, "same\ntext"), (9, None), (None, "a\nb")]
    got = sketch.versions(spark.createDataFrame(rows, schema)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {None: 2, 3: 3, 9: 1}
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 3) == [0.0, 1.0, 1.0]
    (one,) = sketch.versions(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert sketch.versions(spark.createDataFrame([], schema)).count() == 0
    names = spark.createDataFrame([("b", "x"), ("a", "y z w v")], "doc_id string, text string")
    assert {r["doc_id"]: r["edited_sha256"] for r in sketch.versions(names).collect()} == {
        "a": hashlib.sha256(b"y z w x").hexdigest(), "b": hashlib.sha256(b"x").hexdigest()}


def test_compare_and_fingerprints(spark):
    pairs = spark.createDataFrame([("a\nb\nc\n", "a\nB\nc\n", 1), (None, "", 2), ("x", None, 3)], "l string, r string, likeness int")
    rows = sketch.compare(pairs, "l", "r").orderBy("l").collect()
    assert [(round(r["likeness"], 6), len(r["only_left"]), len(r["only_right"])) for r in rows] == [(1.0, 0, 0), (round(2 / 3, 6), 1, 1), (0.0, 1, 0)]
    docs = spark.createDataFrame([(1, "same\ntext"), (2, "same\ntext"), (3, "other"), (None, None)], "doc_id long, text string")
    marks = {r["doc_id"]: r["fingerprint"] for r in sketch.fingerprints(docs).collect()}
    assert marks[1] == marks[2] != marks[3] != marks[None]
    assert sketch.fingerprints(docs.limit(0)).count() == sketch.compare(pairs.limit(0), "l", "r").count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op12(spark, FOLDER).collect()
    assert text_of(sorted(tuple(r) for r in got)) == text_of(sorted(plain_versions([tuple(r) for r in rows])))
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)
