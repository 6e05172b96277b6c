"""Collocations: runs, merge-joins and whole results against plain counting."""

import collections
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from docketflow.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000, cover=100):
    """(lang, rank, phrase, a, l, r, n, score) by counting every stretch of words."""
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i:i + size])] += 1
    found = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= cover * found[lang, w[i:i + size]]:
                    gone.add((lang, w[i:i + size]))
    by = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            cuts = [(1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by[lang].append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted((lang, rank, phrase.decode(), -a, le, ri, total[lang], -score) for lang, every in by.items()
                  for rank, (score, a, phrase, le, ri) in enumerate(sorted(every)[:top], 1))


def mined(spark, rows, least, tmp=None, run_words=phrases.RUN_WORDS, **more):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("a", F.lit("clash"))
    with phrases.Mined(docs, least=least, run_words=run_words) as tables:
        return sorted(tuple(r) for r in phrases.collocations(tables, **more).collect())


def made(seed, n, words="a b c d aa é x\x1cy C".split(), seps=(" ", " ", " ", "\t ", ". ", ",", "\n", "!?", "  ")):
    rng = random.Random(seed)
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 90)))) for _ in range(n)]


@pytest.mark.parametrize("run_words,least,bucket", [(3, 8, 100), (50, 30, 1 << 20)])
def test_equals_counting(spark, run_words, least, bucket, monkeypatch):
    monkeypatch.setattr(phrases, "PHRASES_A_BUCKET", bucket)
    rows = made(1, 150) + [(None, None), ("en", ""), ("en", " . "), ("xx", "once only"), ("en", "a a a a a a a " * 200), ("en", "a b c d e\n" * 40)]
    assert mined(spark, rows, least, run_words=run_words) == plain(rows, least)


def test_ties_cover_and_top(spark):
    rows = made(2, 200, words="a b c".split()) + [("zz", "p q. r s. t u. v w.") for _ in range(9)]
    want = plain(rows, 9, top=3, cover=60)
    assert mined(spark, rows, 9, top=3, cover=60) == want
    assert [r[2] for r in want if r[0] == "zz"] == ["p q", "r s", "t u"]


def test_runs_keep_pieces_whole(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 5)
    run = phrases._Run(0, 2)
    done = list(run.add("en", "A b c d, e f. g")) + list(run.close())
    assert [phrases._unpacked(x.column(1)[0].as_py()).tolist() for x in done] == [[0, 1, 2, 3, 4, 0], [0, 0, 1, 2, 0], [0, 0, 1, 0]]
    assert [zstandard.decompress(x.column("spelled")[0].as_py()) for x in done] == [b"a\nb\nc\nd", b"e\nf", b"g"]
    assert [phrases._unpacked(x.column("counts")[0].as_py()).tolist() for x in done] == [[1, 1, 1, 1], [1, 1], [1]]
    numbers = np.array([0, 1, 70_000, 2**31 - 1], np.int32)
    assert phrases._unpacked(phrases._packed(numbers)).tolist() == numbers.tolist()
    assert phrases._unpacked_starts(phrases._packed_starts(np.array([0, 9]), 11)).tolist() == [0, 9]


def test_empty_and_large_products(spark):
    assert mined(spark, [], 2) == [] and mined(spark, [("en", None), ("en", "a. b")], 1) == []
    wide = spark.createDataFrame([(10**13, 10**13, 10**14, 3 * 10**14), (7, 7, 8, 5)], "a long, l long, r long, n long")
    got = [r[0] for r in wide.select(phrases.score(*map(F.col, "alrn"))).collect()]
    assert got == [1000 * 10**13 * 3 * 10**14 // (10**13 * 10**14), 1000 * 7 * 5 // 56]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13(spark, folder).collect())
    assert got == plain(rows, 100) and len(got) > 10
