"""Edge rules on hand-written rows."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from docketflow import schemas
from docketflow.functions import parse, spans as S
from docketflow.functions.text import html_unescape, unescape_known
from docketflow.operators import corpus, digest, select, state, tagging
from docketflow.operators.ordering import number_rows
from docketflow.sources import corpora, feeds
from docketflow.plans.queries_streaming import _warehouse
from docketflow.operators import scoring


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[1] for r in sorted(df.select("i", column.alias("v")).collect())]


def test_document_type(spark):
    texts = ["[~Util - Modify (Full List)] (<a href='x'>4</a>)", "plain", "[[x]] (y)", " \t[Order] ", None]
    assert values(spark, texts, parse.document_type(F.col("x"))) == ["~Util - Modify", "plain", "x", "Order", None]


def test_unescape_is_one_pass(spark):
    texts = ["&amp;#167; a", "&#167;", "&eacute;", None, "a & b"]
    assert values(spark, texts, html_unescape(F.col("x"))) == ["&#167; a", "§", "é", None, "a & b"]
    assert values(spark, texts[:2], unescape_known(F.col("x"))) == ["&#167; a", "§"]


def test_links(spark):
    texts = ["[A (b)] (<a href=\"https://h/d?caseid=1&de_seq_num=12\" >46</a>)", "[A] (<a href='h?x=1'>n/a</a>)",
             "[A] (<a href='h?de_seq_num=&de_seq_num=%37'> 5 </a>)", "[A] no link"]
    assert values(spark, texts, parse.entry_seq_number(F.col("x"))) == [12, None, 7, None]
    assert values(spark, texts, parse.entry_number(F.col("x"))) == [46, None, 5, None]


def test_titles_and_addresses(spark):
    titles = ["1:21-sw-00001 USA v. X", "nospace"]
    assert values(spark, titles, parse.case_name(F.col("x"))) == ["USA v. X", None]
    assert values(spark, ["http://h/p?123", "nothing"], parse.docket_id(F.col("x"))) == [123, None]


def test_feed_time(spark):
    texts = ["Mon, 07 Jun 2021 19:09:30 GMT", "7 Jun 2021 19:09 -0400", "Mon, 07 Jun 2021 01:00:00 EST", "rubbish"]
    assert values(spark, texts, parse.feed_time(F.col("x"))) == [
        dt.datetime(2021, 6, 7, 19, 9, 30), dt.datetime(2021, 6, 7, 23, 9), dt.datetime(2021, 6, 7, 6), None]


def tagged(spark, rows):
    return spark.createDataFrame(rows, "sent_id string, words array<string>, tags array<string>")


def test_raw_tag_repair(spark):
    df = tagged(spark, [("a", ["x"] * 5, ["B-online account", "I-online account", "I-online account", "O", "B-car"])])
    assert corpus.repaired_export(df).first().tags == [
        "B-ONLINE_ACCOUNT", "I-ONLINE_ACCOUNT", "E-ONLINE_ACCOUNT", "O", "B-CAR"]


def test_decode_tolerates_missing_opener(spark):
    df = tagged(spark, [("a", ["p", "q", "r", "s"], ["O", "I-CAR", "E-CAR", "S-BAG"])])
    found = df.select(S.decode_spans(F.col("words"), F.col("tags")).alias("s")).first().s
    assert [(s.start, s.end, s.text, s.tag) for s in found] == [(1, 3, "q r", "CAR"), (3, 4, "s", "BAG")]


def test_marker_variants(spark):
    rows = [("a", ["Order", "as", "to", "a", "car", "as", "to", "b"], ["O"] * 4 + ["S-CAR"] + ["O"] * 3),
            ("glued", ["was", "total"], ["O", "O"]), ("twice", ["as", "to", "to", "x"], ["O"] * 4)]
    out = corpus.with_marker_variants(tagged(spark, rows)).where("variant = 1").collect()
    assert {r.sent_id: r.words for r in out} == {
        "a": ["USA", "v.", "a", "car", "as", "USA", "v.", "b"], "twice": ["USA", "v.", "USA", "v.", "x"]}


def test_biluo_marks_misaligned(spark):
    text = "seize black phone now"
    tokens = [{"text": w, "start": text.index(w), "end": text.index(w) + len(w), "id": i}
              for i, w in enumerate(text.split())]
    df = spark.createDataFrame([(None, text, tokens, [{"start": 6, "end": 17, "label": "PHONE"},
                                                {"start": 18, "end": 20, "label": "X"}], "accept")],
                               schemas.ANNOTATION)
    assert corpus.tagged_sentences(df).first().tags == ["O", "B-PHONE", "E-PHONE", "-"]


def test_entities_without_and_with_dropped_spans(spark):
    rows = [(1, []), (2, [(0, 1, "g", "L-GEAR")]), (3, [(0, 1, "g", "L-GEAR"), (1, 2, "c", "CAR")])]
    df = spark.createDataFrame(rows, f"doc int, spans array<{S.SPAN_TYPE}>")
    out = {(r.doc, r.thing_searched, r.category) for r in tagging.entity_rows(df).collect()}
    assert out == {(1, None, "no category detected"), (3, "c", "CAR")}


def test_bare_name_is_replaced_whole(spark):
    df = spark.createDataFrame([(1, "USA v.", "c", "g&e=1", "t"), (2, "USA v. X", "c", "g", "t")],
                               "n int, case_name string, court string, guid string, document_type string")
    out = {r.doc_order: r.description for r in select.to_alert_shape(df, "n").collect()}
    assert out[1].startswith("Search/Seizure") and out[2] == "USA v. X"


def test_numbering_of_a_hot_group(spark):
    """One court holds nearly all lines; numbers stay complete and in order."""
    df = spark.range(20000).select(F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("g"), "id")
    out = number_rows(df, ["g"], ["id"], "n")
    wrong = out.groupBy("g").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.countDistinct("n").alias("d"))
    assert all(r.c == r.m == r.d for r in wrong.collect())
    assert [r.id for r in out.where("g = 'a'").orderBy("n").limit(3).collect()] == [1, 2, 3]


def test_blocks_and_parts(spark):
    rows = [(i, 0, "CAR", "c1", f"n{i}", f"u{i}", None) for i in range(7)]
    entities = spark.createDataFrame(rows, "doc_order long, span_pos int, category string, court_id string, "
                                     "case_name string, absolute_url string, thing_searched string")
    blocks = digest.message_blocks(digest.digest_cases(entities), "hi", 3, 2).orderBy("block_no").collect()
    assert [b.kind for b in blocks] == ["section", "divider"] + ["section"] * 4
    assert [b.message_no for b in blocks] == [0, 0, 1, 1, 2, 2]
    assert sum(b.text.count("• ") for b in blocks if b.text) == 7
    assert digest.message_blocks(digest.digest_cases(entities.limit(0)), "hi").count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_upsert_is_idempotent_and_purge_empties_months(spark, parts):
    target = _warehouse(spark, parts).table("rss_docket_entries")
    base = {c: None for c in schemas.DOCKET.names}
    day = dt.datetime(2021, 6, 1)

    def batch(*rows):
        full = [{**base, **r, "batch_position": i} for i, r in enumerate(rows)]
        names = [*schemas.DOCKET.names, "batch_position"]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in full],
                                     schemas.DOCKET.simpleString()[7:-1].replace(":", " ") + ", batch_position bigint")

    first = batch({"case_number": "1", "pub_date": day, "scrape_date": day, "case_name": "old"},
                  {"case_number": "1", "pub_date": day, "scrape_date": day, "case_name": None},
                  {"case_number": "2", "pub_date": dt.datetime(2021, 7, 1), "scrape_date": day, "case_name": "x"})
    for _ in range(2):
        state.upsert_docket(target, first, "batch_position")
        assert sorted((r.case_number, r.case_name) for r in target.read().collect()) == [("1", None), ("2", "x")]
    seen = spark.createDataFrame([("1", day)], "case_number string, pub_date timestamp_ntz")
    state.purge_docket(target, seen)
    assert [p[0] for p in target.partitions()] == ["2021-06"] and target.read().count() == 1


def test_replacing_other_partitions_is_refused(spark):
    target = _warehouse(spark).table("courtlistener_predictions")
    rows = spark.createDataFrame([("k", "u", "t", True, 1.0)], schemas.URL_CLASS_LOG)
    with pytest.raises(ValueError):
        target.replace(rows, [])
    assert target.read().count() == 0


def test_log_replay_adds_nothing(spark):
    log = _warehouse(spark).table("courtlistener_predictions")
    scored = spark.createDataFrame([("u", 1, 0.9)], "absolute_url string, predicted_class int, likelihood double")
    for kind in ("swornot_recap", "swornot_recap", "other"):
        log.append(state.class_log_rows(scored, ["absolute_url"], kind), "log_key")
    assert sorted(r.prediction_type for r in log.read().collect()) == ["other", "swornot_recap"]


def test_parts_carry_heading_and_number(spark):
    rows = [(i, 0, "CAR", "c1" if i < 1100 else None, f"n{i}", f"u{i}", None) for i in range(1103)]
    entities = spark.createDataFrame(rows, "doc_order long, span_pos int, category string, court_id string, "
                                     "case_name string, absolute_url string, thing_searched string")
    blocks = digest.message_blocks(digest.digest_cases(entities)).where("kind = 'section'").orderBy("block_no").collect()
    assert [b.text.split("\n")[0] for b in blocks] == ["*CAR:*", "*:*", "*c1:*", "*c1 (2):*", "*c1 (3):*"]
    assert sum(b.text.count("• ") for b in blocks) == 1103


def test_words_are_the_same_for_both_linear_scorers(spark):
    texts = ["the\u00a0of the", "the\x0bthe the.", " the\tTHE!\r\nof ", None, "\u2003the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    weights = {"the": 2.0, "of": -5.0}
    a = scoring.linear_score(df.fillna(""), "x", weights, -0.5).orderBy("i").collect()
    b = scoring.score_with(df, "x", scoring.linear_factory(weights, -0.5)).orderBy("i").collect()
    assert [(r.predicted_class, round(r.likelihood, 9)) for r in a] == [(r.predicted_class, round(r.likelihood, 9)) for r in b]


def test_long_texts_take_time_in_proportion(spark):
    """Four times the words, far less than sixteen times the time."""
    def seconds(n):
        df = spark.createDataFrame([(i, "the of license de the lorem ipsum dolor sit amet " * (n // 10)) for i in range(3)],
                                   "i int, x string").coalesce(1)
        best = []
        for _ in range(3):
            begin = time.perf_counter()
            df.select(F.size(tagging.dictionary_spans(F.col("x"), {"license": "D", "the of": "P", "of license de": "Q"})),
                      F.size(S.with_offsets(F.split("x", " ")))).collect()
            best.append(time.perf_counter() - begin)
        return min(best)
    seconds(1_000)
    short, long = seconds(5_000), seconds(20_000)
    assert long < 9 * short + 0.5


def test_phrases_of_any_length(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x a b c. D e")], "k int, t string")
    phrases = spark.createDataFrame([("a b c d e f", "SIX"), ("a b c d e", "FIVE"), ("g", "ONE"), ("b", "IN")], "phrase string, tag string")
    found = {(r.k, r.start, r.end, r.tag) for r in tagging.dictionary_matches(df, "k", "t", phrases).collect()}
    assert found == {(1, 0, 6, "SIX"), (1, 6, 7, "ONE"), (2, 1, 6, "FIVE")}


def test_examples_may_share_a_key(spark):
    examples = spark.createDataFrame([("k", "car x", [(0, 3, "OBJ")]), ("k", "bus y", [(0, 3, "OBJ")])],
                                     "k string, text string, spans array<struct<start:int,end:int,label:string>>")
    labels = spark.createDataFrame([("car", "CAR"), ("car", "AUTO")], "token string, label string")
    got = corpus.lookup_span_labels(examples, labels).collect()
    assert sorted((r.text, r.spans[0].label) for r in got) == [("bus y", "MISC"), ("car x", "CAR")]


def test_rejected_sequence_numbers_are_quarantined(spark):
    df = spark.createDataFrame([("g", "c", "1:21-sw-1 x", "h?1", "[A] (<a href=\"h?de_seq_num=x7\">3</a>)", dt.datetime(2021, 1, 1))],
                               "guid string, court string, title string, link string, description string, pub_date timestamp_ntz")
    assert [(r.rule, r.text) for r in feeds.feed_quarantine(df).collect()] == [("docket_entry_seq_num", "x7")]


def test_corpus_files(spark, tmp_path):
    file = tmp_path / "a.conll"
    file.write_text("-DOCSTART- -X- O O\nthe -X- _ O\nGoogle -X- _ B-online account\n\n\nx -X- _ O\n\n")
    rows = corpora.read_label_tool_export(spark, str(file)).collect()
    assert sorted((r.words, r.tags) for r in rows) == [
        (["the", "Google"], ["O", "B-online account"]), (["x"], ["O"])]
    ragged = tmp_path / "b.conll"
    ragged.write_text("a\tO\nred car   S-CAR\n\n")
    assert corpora.read_corpus(spark, str(ragged)).first().words == ["a", "red car"]


def test_plans(spark):
    from docketflow.plans.catalog import QUERIES
    folder = "/root/testdata/sf0.001"

    def plan(name):
        return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()

    assert "LeftAnti" in plan("candidates") and "Cartesian" not in plan("candidates")
    assert plan("sample_per_group").count("WindowGroupLimit") == 2
    assert "BatchEvalPython" not in plan("feed_normalise") and "ArrowEvalPython" not in plan("feed_normalise")
    assert "Exchange" not in plan("raw_tags_repair") and "Exchange" not in plan("linear_score")
