"""Secrets, tokenizers, token files and page texts."""

import base64
import hashlib
import random
import time
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm import brute  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketflow.llm import bpe, html_text, queries, secrets, tokenfile
from docketflow.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "it's  ok\n\n\tnow ", "x" * 5000, " " * 9000 + "end", "w" + "\n" * 9000, "é é 中文\U0001f600",
       "word " * 20_000, ".,;!" * 300, "a\x1cb c\x01d \x01", "<|endoftext|> x", "ΣΟΣ. Σ", "tab\tseparated blank wide"]


def decoded(text):
    found = secrets.scan(text)
    return found[0], [x for x in found[1] if x not in found[0]]


def test_base_findings():
    text = 'password: "hunter2hunter2" TOKEN=abc API_KEY = \'abcd.efgh\' AKIAABCDEFGHIJKL AKIAshort ' + "f" * 31 + " " + "0a" * 16
    base, more = decoded(text)
    assert [(k, text[a:b]) for k, a, b in base] == [
        ("assign", 'password: "hunter2hunter2'), ("assign", "API_KEY = 'abcd.efgh"), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0a" * 16)]
    assert more == []


def test_failing_match_still_consumes():
    assert secrets.scan("password: token: abcdefgh")[0] == []
    assert secrets.scan("ſecret=abcdefgh")[0] == []


@pytest.mark.parametrize("wrap", ["b64", "lines", "zlib", "gzip", "url", "url2", "unicode", "b64url", "nested"])
def test_layers_map_back(wrap):
    secret = "password=hunter2hunter2"
    made = {
        "b64": base64.b64encode(secret.encode()).decode(),
        "lines": base64.encodebytes(zlib.compress(random.Random(1).randbytes(90).hex(" ").encode() + secret.encode())).decode().strip(),
        "zlib": base64.b64encode(zlib.compress(secret.encode())).decode(),
        "gzip": base64.b64encode(__import__("gzip").compress(secret.encode())).decode(),
        "url": "".join(f"%{c:02x}" for c in secret.encode()),
        "url2": urllib.parse.quote("".join(f"%{c:02x}" for c in secret.encode())),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in secret),
        "b64url": base64.urlsafe_b64encode(("ÿþ?>" + secret).encode()).decode(),
        "nested": base64.b64encode(base64.b64encode(zlib.compress(urllib.parse.quote(secret).encode())).decode().encode()).decode(),
    }[wrap]
    text = f"before {made} after"
    base, more = decoded(text)
    assert base == [] and len(more) >= 1
    kind, start, end = more[0]
    assert kind == "assign" and 7 <= start < end <= 7 + len(made)
    if wrap in ("url", "unicode", "url2"):
        assert (start, end) == (7, 7 + len(made))
    assert "hunter2" not in secrets.mask(text) and made not in secrets.mask(text)


def test_cycles_and_bombs_end():
    bomb = base64.b64encode(zlib.compress(b"z" * 3_000_000)).decode()
    assert secrets.scan(bomb)[1] == []
    assert secrets.scan("%25" * 2000)[1] == []
    deep = "secret=abcdefghi"
    for _ in range(12):
        deep = urllib.parse.quote(deep, safe="")
    assert [x[0] for x in secrets.scan(deep)[1]] == ["assign"]


@pytest.mark.parametrize("noise", [b"\0", b"\x1b[31m", b"\xe9", "é".encode() + b"\xff"])
@pytest.mark.parametrize("pack", [bytes, zlib.compress])
def test_layers_that_are_not_plain_text(noise, pack):
    made = base64.b64encode(pack(b"some = thing" + noise + b"password=hunter2hunter2" + noise + b"end")).decode()
    text = f"before {made} after"
    (kind, start, end), = secrets.scan(text)[1]
    assert kind == "assign" and 7 <= start < end <= 7 + len(made) and secrets.mask(text) != text
    assert pack is zlib.compress or b"password=hunter2hunter2" in base64.b64decode(made[(start - 7) // 4 * 4:-(-(end - 7) // 4) * 4])


@pytest.mark.parametrize("module", ["gzip", "bz2", "lzma"])
def test_layers_of_several_members(module):
    pack = __import__(module).compress
    text = base64.b64encode(pack(b"nothing, ") + pack(b"password=hunter2hunter2")).decode()
    assert ("assign", 0, len(text)) in secrets.scan(text)[1]
    text = base64.b64encode(pack(pack(b"nothing, ") + pack(b"password=hunter2hunter2"))).decode()
    assert ("assign", 0, len(text)) in secrets.scan(text)[1]


def test_layers_beyond_32_mb(monkeypatch):
    data = "é, some line of a log\n".encode() * 1_500_000 + b"password=hunter2hunter2"
    text = base64.b64encode(zlib.compress(data)).decode()
    assert secrets.scan(text)[1] == [("assign", 0, len(text))]
    monkeypatch.setattr(secrets, "CHUNK", 7)
    monkeypatch.setattr(secrets, "WINDOW", 10)
    inner = base64.b64encode(b"secret=abcdefghi, " * 9)
    text = base64.b64encode(zlib.compress(b"x, " * 99 + inner)).decode()
    assert secrets.scan(text)[1] == [("assign", 0, len(text))]


def test_layers_are_not_counted():
    """More than 10,000 layers, the secret in the one that was taken up last."""
    many = " ".join(base64.b64encode(f"entry number {i:08d}".encode()).decode() for i in range(11_000))
    text = f"{many} {base64.b64encode(b'password=hunter2hunter2').decode()}"
    assert [x[0] for x in secrets.scan(text)[1]] == ["assign"] and secrets.mask(text).endswith("<assign>")


SECRET = b"password=hunter2hunter2"


@pytest.mark.parametrize("glue", ["https://h.example/a/", "-", "a", "ab", "abc", "x=", "data:text/plain;base64,", "/", "_"])
@pytest.mark.parametrize("pack", [bytes, zlib.compress, __import__("gzip").compress, __import__("bz2").compress, __import__("lzma").compress])
def test_runs_at_any_place(glue, pack):
    made = base64.b64encode(pack(b"some = thing, " + SECRET)).decode()
    text = f"see {glue}{made} end"
    found = [x for x in secrets.scan(text)[1] if x[0] == "assign"]
    assert found and all(4 <= a < b <= 4 + len(glue) + len(made) for _, a, b in found)
    assert "hunter2" not in secrets.mask(text) and len(secrets.mask(text)) < len(text)


@pytest.mark.parametrize("width", [4, 5, 20, 39, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
def test_lines_of_any_width(width, end):
    made = base64.b64encode(b"some = thing, " + SECRET).decode()
    text = "x\n\n" + end.join(made[i:i + width] for i in range(0, len(made), width)) + "\n\ny"
    assert [x[0] for x in secrets.scan(text)[1]] == ["assign"]


@pytest.mark.parametrize("code", ["utf-16", "utf-16-le", "utf-16-be", "utf-32"])
@pytest.mark.parametrize("pack", [bytes, zlib.compress])
def test_wide_characters(code, pack):
    text = base64.b64encode(pack("some = thing, password=hunter2hunter2, end".encode(code))).decode()
    (kind, start, stop), = secrets.scan(text)[1]
    assert kind == "assign" and 0 <= start < stop <= len(text)


@pytest.mark.parametrize("module,size", [("bz2", 1 << 20), ("lzma", 5 << 20), ("bz2", 60 << 20), ("gzip", 40 << 20)])
def test_secrets_far_behind(module, size):
    text = base64.b64encode(__import__(module).compress(b"\0" * size + SECRET)).decode()
    found = secrets.scan(text)
    assert ("assign", 0, len(text)) in found[1] and not found[2]


def test_data_made_to_explode_are_marked(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_DECODED", 3 << 20)
    bomb = base64.b64encode(__import__("lzma").compress(b"z" * (8 << 20))).decode()
    assert secrets.scan(f"token=abcdefgh1 {bomb}")[1:] == ([("assign", 0, 15)], True)
    assert secrets.scan("token=abcdefgh1")[2] is False


def test_base_of_the_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op2(spark, FOLDER).collect()
    assert len(got) == len(texts) and not any(r["stopped"] for r in got)
    for r in got:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.secrets(texts[r["doc_id"]])


def test_secret_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (2, "token=abcdefgh1", "s"), (None, "x " * 50_000 + "secret: abcdefgh", "s")]
    got = secrets.digests(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert sorted((str(r["doc_id"]), r["n_assign"], r["spans"]) for r in got) == [
        ("1", 0, ""), ("2", 0, ""), ("2", 1, "assign:0:15"), ("None", 1, "assign:100000:100016")]
    assert secrets.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert secrets.mask(None) is None and secrets.mask("token=abcdefgh1!") == "<assign>!"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_library(ranks):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    parts = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parts, special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\tab'1.é ") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    texts += ["".join(rng.choice([" ", "\n", "abc", " " * 2500, "x1", "'s"]) for _ in range(60)) for _ in range(10)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == plain.encode_ordinary(text or "") and codec.decode(ids) == (text or "").encode()


def test_bpe_cuts_change_nothing(ranks, monkeypatch):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = " ".join(["it's  a  test,", "of\ncuts 123"] * 800)
    whole = codec._pieces.encode_ordinary(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(bpe, "CUT_CHARS", size)
        assert codec.encode(text) == whole


def test_very_long_blank_run(ranks):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = "a" + " " * 1_200_000 + "b"
    assert codec.decode(codec.encode(text)) == text.encode()


def test_bpe_rows(spark, ranks):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in bpe.digests(df, ranks, public_tokenizers.PATTERN).collect()}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(ODD))
    there = bpe.decode_ids(bpe.encode_texts(df, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert there.columns == ["doc_id", "text", "token_ids", "n_tokens", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"]) for r in there.collect())
    assert bpe.digests(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected_files(tokenizer, rows):
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("length,file_tokens", [(8, 50), (2048, 4_000_000)])
def test_token_files(spark, tokenizer, length, file_tokens):
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD)] + [(200, "twin"), (200, "twin"), (200, "other")]
    data = tokenfile.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    folder = scratch_path(spark, "tokens")
    df = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, start string").repartition(5)
    manifest = tokenfile.write_tokens(df, folder, data, length=length, file_tokens=file_tokens)
    want = sorted(expected_files(tokenizer, sorted(rows, key=lambda r: (r[0], r[1] or ""))))
    assert sorted(tuple(r) for r in tokenfile.read_digests(manifest, folder).collect()) == want
    read = tokenfile.read_documents(manifest, folder).collect()
    assert sorted((r["doc_id"], r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in read) == want
    name = manifest.orderBy("name").first()["name"]
    with tokenfile.open_sequences(f"{folder}/files/{name}") as file:
        batch = file.get_batch(0)
    assert batch.schema.field("ids").type.list_size == length and len(batch["ids"][0]) == length
    mask = batch["mask"].values.to_numpy(zero_copy_only=False)
    assert mask.sum() == manifest.where(F.col("name") == name).first()["tokens"] and not mask[mask.sum():].any()


def test_token_files_empty_and_whole_table(spark, tokenizer):
    data = tokenfile.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    folder = scratch_path(spark, "tokens")
    manifest = tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, data)
    assert tokenfile.read_documents(manifest, folder).count() == 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in queries.op9(spark, FOLDER).collect())
    assert got == expected_files(tokenizer, docs)


def test_chunks_equal_whole_texts(tokenizer):
    encoder = tokenfile.ChunkEncoder(tokenfile.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(3)
    letters = "aZbÉéßŸſÿ'.,!_-(\"0١Σςİıǅ中\u0301\u2003\xa0 \x85\x1c\x01 \n\t<|e>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2_000)]
    texts += ["<|endoftext|> a <|ENDOFTEXT|>", "don't I'LL we're 'S's", None, "straße.. (naïve) été,"]
    for text, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_memo_starts_anew(tokenizer, monkeypatch):
    encoder = tokenfile.ChunkEncoder(tokenfile.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    monkeypatch.setattr(tokenfile, "MEMO_CHUNKS", 3)
    for _ in range(3):
        got = encoder.encode(pa.array(ODD))
        assert all(g.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids for g, t in zip(got, ODD))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body class="nav-open">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s<aside><p>Buy this very long product description that goes on and on for ever and ever.</p></aside>
<section id="comments"><article class="comment"><p>A reader says a very long thing that should never be seen in any output.</p></article></section>
<form><label>Mail</label><input></form><footer>&copy; x</footer></body></html>"""


def test_article_page():
    body = "<article><header><h1>Head &amp; line</h1></header><div class='ad'>Advert</div><p>One <b>bold\n  word<br>next</b> &eacute;&#233;.<p>Two &a</article>"
    assert html_text.extract(PAGE % body) == "Head & line\nOne bold word next éé.\nTwo &a"


def test_page_without_article():
    body = "<div class=content><h2>Head</h2><p>" + "A long first paragraph of the story. " * 4 + "</p><p>Short.</p></div><div class=sidebar>Side</div>"
    assert html_text.extract(PAGE % body).split("\n")[0::2] == ["Head", "Short."]


LONG = "A long paragraph of the story goes on and on, with many words in it. " * 3
STORY = [LONG.strip(), "Short line of it.", LONG.strip() + " More."]
BODY = "".join(f"<p>{x}</p>" for x in STORY)
NOISY = "<nav><a href=/>Home</a></nav>%s<div class='cookie-notice'><p>We use cookies, and say so in a long sentence here.</p></div><footer>Foot</footer>"


@pytest.mark.parametrize("page", [
    BODY, f"<div>{BODY}</div>", f"<div id=content>{BODY}</div>", f"<section>{BODY}</section>", f"<table><tr><td>{BODY}</td></tr></table>",
    f'<div class="has-sidebar">{BODY}</div>', f'<div class="layout with-sidebar">{BODY}</div>', f'<div id="search-results">{BODY}</div>',
    f'<div class="page no-cookie">{BODY}</div>', f'<div class="menu-planner">{BODY}</div>', f'<div class="share-price">{BODY}</div>',
    f'<div class="sidebar">{BODY}</div>', f'<div class="widget content">{BODY}</div>', f'<div id="alert">{BODY}</div>',
    f'<div><div class="sidebar-left"><p>Beside it.</p></div><div>{BODY}</div></div>',
    f'<div>{BODY}</div><div class="related-posts"><ul><li>Other story of them</li></ul></div>',
    f'<div>{BODY}</div><section id="comments"><p>{LONG}</p></section>', f'<div>{BODY}</div><div role="complementary">{LONG}</div>',
    f'<div>{BODY}</div><div hidden>{LONG}</div>', f'<div>{BODY}</div><div style="display: none">{LONG}</div>',
    f'<div>{BODY}</div><aside><p>{LONG}</p></aside>', f'<div>{BODY}</div><form><p>{LONG}</p></form>',
    f'<div>{BODY}</div><span class="ad">Buy <span>it</span> now</span>',
    f'<div class="search-results"><article>{BODY}</article></div>', f'<div class="sidebar"><main>{BODY}</main></div>',
    f'<main><div class="related-work">{BODY}</div></main>', f'<main>{BODY}<div class="newsletter-signup">Join us</div></main>'])
def test_pages_of_many_forms(page):
    for made in (page, NOISY % page, f"<html><body class='nav-open sidebar'>{NOISY % page}</body></html>"):
        assert html_text.extract(made).split("\n") == STORY


def test_several_articles():
    page = NOISY % "".join(f"<article><h2>Head {i}</h2><p>{LONG}</p></article>" for i in range(3))
    assert html_text.extract(page).split("\n") == [x for i in range(3) for x in (f"Head {i}", LONG.strip())]
    teaser = f"<article><p>{LONG * 9}</p></article><article><a href=x>Other</a></article>"
    assert html_text.extract(teaser) == (LONG * 9).strip()


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "<p>text</p>" * 10, "<article>" + "<b>x " * 20_000, "<h1>" * 20_000 + "<p>a</p>" * 1_000,
                                  "<div>" * 20_000 + "text", "<p><div>" + "<h2>x" * 20_000, "<i><p>" * 20_000 + "x"])
def test_open_tags_take_time_in_proportion(page):
    begin = time.perf_counter()
    assert html_text.extract(page)
    assert time.perf_counter() - begin < 5


def test_awkward_pages(spark):
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>only</nav>") == ""
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "<p>" + "x" * 300_000
    assert html_text.extract(long).count("\n") == 20_000 and html_text.extract(long).endswith("x" * 300_000)
    rows = [(1, "u", None, "c"), (1, "u", "<article><p>a</article>", "c"), (None, None, "<article>b", "c")]
    got = html_text.texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("a", 1), ("b", 1)]
    assert html_text.texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_pages_table(spark):
    """Every page's article, cut out by plain string work."""
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.op4(spark, FOLDER).collect():
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
