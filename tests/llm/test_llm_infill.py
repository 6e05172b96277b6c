"""Fill-in-middle: piece tables against plain string work."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from docketflow.llm import infill

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "a", " \n\t ", "one two", "é  中文\U0001f600 x\n", "<P> here", "a <S", "<M", "P><", "<<P", "x" * 5000, "w \n" * 9000,
       "< P><S ><M", "a\x1cb\x85c d"]


def plain(key, text):
    text = text or ""
    digits = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digits[i:i + 8], 16) for i in range(0, 32, 8)]
    units = TOKENS.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_cutting_splits_descriptors():
    table = infill.PieceTable("abcdef", ((infill.TEXT, 0, 2), infill.PREFIX, (infill.TEXT, 2, 4)))
    assert table.render() == "ab<P>cdef"
    parts = table.cut(1, 7)
    assert ["".join(infill.PieceTable("abcdef", p).chunks()) for p in parts] == ["a", "b<P>cd", "ef"]
    assert ["".join(infill.PieceTable("abcdef", p).chunks()) for p in table.cut(0, 9)] == ["", "ab<P>cdef", ""]
    assert ["".join(infill.PieceTable("abcdef", p).chunks()) for p in table.cut(2, 2)] == ["ab", "", "<P>cdef"]


def test_forms_and_round_trip(monkeypatch):
    monkeypatch.setattr(infill, "CHUNK", 3)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("<>PSM ab\n") for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    met = set()
    for key, text in enumerate(texts):
        n, form, one, two, table = infill.arrange(key, text)
        want = plain(key, text)
        assert (n, form, table.render()) == (want[0], want[1], want[4])
        assert form == "plain" or (one, two - one) == want[2:4]
        assert table.sha256() == hashlib.sha256(want[4].encode()).hexdigest()
        assert infill.restored(want[4], form).render() == (text or "")
        met.add(form)
    assert met == {"plain", "psm", "spm"}


def test_rows(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD * 3)] + [(None, "a b c", "s"), (7, "twin", "s"), (7, "twin", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_form string")
    made = infill.restore(infill.transform(docs))
    assert made.columns == ["doc_id", "text", "fim_text", "fim_form", "fim_pieces", "restored"]
    for r in made.collect():
        assert r["restored"] == (r["text"] or "")
        n, form, _, _, out = plain("" if r["doc_id"] is None else r["doc_id"], r["text"])
        assert (r["fim_form"], r["fim_text"]) == (form, out)
        assert sum(p["length"] for p in r["fim_pieces"]) == len(out)
    got = infill.digests(docs.withColumn("n", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r["restored_sha256"] for r in got)
    assert infill.digests(docs.limit(0)).count() == infill.transform(docs.limit(0)).count() == 0


def test_rates(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    forms = {r["form"]: r["count"] for r in infill.digests(docs, rate=100, spm_rate=0).groupBy("form").count().collect()}
    assert forms == {"psm": 400}
