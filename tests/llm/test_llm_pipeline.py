"""The pipeline against a brute-force version, and stages on awkward rows."""

import base64

import pytest
from llm import brute

import corpus_pipeline
import public_tokenizers
import tiktoken
from docketflow.llm import bpe, quality, secrets

FOLDER = "/root/testdata/sf0.001"


def plain_run(spark, folder):
    """All stages by hand, with the classifier's own scores."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    rows = [r for r, s in zip(rows, machine.score([r["text"] for r in rows])) if s >= quality.THRESHOLD]
    rows = [r for i, (r, root) in enumerate(zip(rows, brute.groups([r["text"] for r in rows])[1])) if root == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for r, c in zip(rows, brute.contamination([r["text"] for r in rows], items)) if not c[-1]]
    data = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    codec = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for r in rows:
        text = r["text"]
        for kind, start, end in sorted(secrets.scan(text)[0], key=lambda x: -x[1]):
            text = text[:start] + f"<{kind}>" + text[end:]
        out[r["doc_id"]] = (text, r["lang"], r["source"], len(text), codec.encode_ordinary(text))
    return out


def test_run_equals_plain_version(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens"]
    made = {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"], r["token_ids"]) for r in got.collect()}
    want = plain_run(spark, FOLDER)
    assert made.keys() == want.keys()
    overlapping = [k for k in want if made[k] != want[k]]
    assert all("<" in made[k][0] for k in overlapping) and len(overlapping) <= len(want) // 50


@pytest.fixture(scope="module")
def awkward(spark):
    text = "some words of a text that goes on for a while and has an end"
    rows = [(1, text, "en", "s", 60, "x", 7), (1, text, "en", "s", 60, "x", 7), (2, text + " .", None, None, None, None, None),
            (None, None, None, None, None, "y", 1), (3, "", "en", "s", 0, "z", 2), (4, "token=abcdefgh1 " * 3, "en", "s", 48, "z", 2),
            (5, "long " * 60_000, "en", "s", 300_000, "z", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token_ids string, mark int")


def test_stages_on_awkward_rows(spark, awkward):
    folder = FOLDER
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, awkward, folder).columns == awkward.columns
    unique = stages["near_duplicates"](spark, awkward, folder)
    assert unique.columns == awkward.columns and unique.where("doc_id = 1").count() == 1
    kept = stages["decontamination"](spark, awkward, folder)
    assert kept.columns == awkward.columns and kept.count() == 7
    masked = stages["secrets"](spark, awkward, folder).where("doc_id = 4").first()
    assert masked["text"] == "<assign> " * 3 and masked["n_chars"] == 27
    ids = stages["token_ids"](spark, awkward, folder)
    assert ids.columns == ["doc_id", "text", "lang", "source", "n_chars", "mark", "token_ids", "n_tokens"] and ids.count() == 7
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), folder).count() == 0, name


def test_near_duplicates_keep_the_smallest_id(spark):
    text = "some words of a text that goes on for a while and has an end"
    rows = [(None, text), (7, text), (5, text + "  "), (5, text + "  "), (None, "quite another one"), (None, "quite another one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, FOLDER)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("5", text + "  "), ("None", "quite another one")]


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert "op10_decontamination" in entry.oracle_sql()
