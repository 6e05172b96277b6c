"""Replaced partitions, key sketches, checked appends, nested children, dictionaries, digests with equal places."""

import datetime as dt
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from docketflow import schemas
from docketflow.functions import spans
from docketflow.operators import automaton, digest, gate, large_dictionary, scoring, state, tagging, training
from docketflow.plans import queries_state, queries_streaming
from docketflow.plans.queries_streaming import _stream, _warehouse
from docketflow.session import file_names
from docketflow.sources import feeds
from docketflow.sources.tables import Table
from docketflow.streaming import alerts, ingest


def log_rows(spark, addresses, value=True):
    return spark.createDataFrame([(f"k{a}", a, "t", value, 1.0) for a in addresses], schemas.URL_CLASS_LOG)


def held(table):
    return sorted((r.absolute_url, r.prediction_value) for r in table.read().collect())


def test_replacement_that_stops_is_completed_by_the_next_reader(spark, monkeypatch):
    warehouse = _warehouse(spark)
    table = warehouse.table("courtlistener_predictions")
    addresses = [f"u{i}" for i in range(40)]
    old = log_rows(spark, addresses)
    table.replace(old, table.partitions_of(old))
    parts = table.partitions()
    new = log_rows(spark, addresses[:20], False).where(F.substring(F.md5("absolute_url"), 1, 1) < "8")
    plain = Table._switch

    def stops(self, intent):
        (first, *_) = intent["written"]
        spark.sql(f"ALTER TABLE {self.name} {self._spec(tuple(first))} SET LOCATION '{intent['version']}/{self._folder(tuple(first))}'")
        raise OSError("stopped")
    monkeypatch.setattr(Table, "_switch", stops)
    with pytest.raises(OSError):
        table.replace(new, parts)
    monkeypatch.setattr(Table, "_switch", plain)
    again = warehouse.table("courtlistener_predictions")
    want = sorted((r.absolute_url, False) for r in new.collect())
    assert held(again) == want and 0 < len(want) < 20
    assert sorted(again.partitions()) == sorted(again.partitions_of(new))
    again.append(log_rows(spark, ["u1", "v1"]), "log_key")
    again.replace(log_rows(spark, ["v1"]), again.partitions())
    assert held(again) == [("v1", True)]
    root = again.location()
    places = [root, *[f"{root}/_versions/{n}" for n in file_names(spark, f"{root}/_versions")]]
    assert sum("=" in n for place in places for n in file_names(spark, place)) == 1


def test_sketch_opens_only_partitions_that_may_hold_a_key(spark):
    log = _warehouse(spark).table("courtlistener_predictions")
    log.append(log_rows(spark, [f"u{i}" for i in range(300)]), "log_key")   # before there is a sketch
    sketch = log.sketch()
    log.append(log_rows(spark, [f"w{i}" for i in range(300)]), "log_key")   # kept by the append
    batch = spark.createDataFrame([("u7",), ("w8",), ("x1",), ("x2",), (None,), ("x1",)], "absolute_url string")
    possible = sketch.possible(batch)
    assert {r.absolute_url for r in possible.collect()} == {"u7", "w8"}
    assert len(sketch.table.touched(possible)) <= 2 < len(log.partitions())
    got = sorted(str(r.absolute_url) for r in sketch.unseen(batch).collect())
    assert got == ["None", "x1", "x1", "x2"]
    files = {f.split("url_part=")[1][0] for f in log.read(sketch.table.touched(possible)).inputFiles()}
    assert len(files) <= 2
    sketch.rebuild()
    assert {r.absolute_url for r in sketch.possible(batch).collect()} == {"u7", "w8"}
    assert sketch.table.read().groupBy("url_part", "word").count().where("count > 1").isEmpty()


def test_full_sketch_stays_exact(spark):
    from docketflow.sources.key_sketch import KeySketch
    log = _warehouse(spark).table("courtlistener_predictions")
    log.append(log_rows(spark, [f"u{i}" for i in range(400)]), "log_key")
    sketch = KeySketch(log, ["absolute_url"], words=1)
    sketch.rebuild()
    batch = spark.createDataFrame([(f"u{i}",) for i in range(390, 410)], "absolute_url string")
    assert {r.absolute_url for r in sketch.unseen(batch).collect()} == {f"u{i}" for i in range(400, 410)}


def test_checked_append_replays(spark, tmp_path):
    table = _warehouse(spark).table("courtlistener_predictions")
    table.append(log_rows(spark, ["a"]), "log_key")
    batch = log_rows(spark, ["a", "b", "c", "b", None]).withColumn("place", F.monotonically_increasing_id())
    parent = spark.createDataFrame([("a",), ("b",)], "url string")
    for _ in range(2):
        judged = gate.append_checked(table, batch, ["absolute_url"], ["place"], str(tmp_path / "verdicts"), parent, {"absolute_url": "url"})
        got = sorted((str(r.absolute_url), str(r.violation)) for r in judged.collect())
        assert got == [("None", gate.NULL_KEY), ("a", gate.EXISTS), ("b", "None"), ("b", gate.REPEATS), ("c", gate.NO_PARENT)]
        assert held(table) == [("a", True), ("b", True)]
    empty = gate.gated(batch.limit(0), table.read(), ["absolute_url"], ["place"])
    assert empty.count() == 0 and empty.columns == [*batch.columns, gate.RULE]


def test_children_of_a_hot_entry(spark):
    day = dt.datetime(2021, 6, 1)
    docket = spark.createDataFrame([("1", day), ("2", day), (None, day)], "case_number string, pub_date timestamp_ntz")
    classes = spark.range(2_500).select(F.lit("1").alias("case_number"), F.lit(day).cast("timestamp_ntz").alias("pub_date"),
                                        F.format_string("t%05d", "id").alias("prediction_type"), (F.col("id") % 2 == 0).alias("prediction_value"))
    entities = spark.createDataFrame([("1", day, "e", "CAR", "car"), ("1", day, "e", "CAR", None)],
                                     "case_number string, pub_date timestamp_ntz, prediction_type string, prediction_value string, prediction_substring string")
    rows = state.nested_children(docket, classes, entities).orderBy("case_number", "part_no").collect()
    assert [(r.case_number, r.part_no, len(r.classes), len(r.entities)) for r in rows] == [
        (None, 0, 0, 0), ("1", 0, 1000, 0), ("1", 1, 1000, 0), ("1", 2, 500, 2), ("2", 0, 0, 0)]
    assert [c.prediction_type for r in rows for c in r.classes] == [f"t{i:05d}" for i in range(2_500)]
    assert [e.prediction_substring for e in rows[3].entities] == [None, "car"]


def test_automaton_equals_the_joined_dictionary(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "A.", "b,", "...", "é", "(c)"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "k int, t string")
    phrases = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice("XY")) for _ in range(40)]
                                    + [("", "X"), ("a", None)], "phrase string, tag string")
    fast = {tuple(r) for r in automaton.tag_documents(df, "k", "t", phrases).collect()}
    dealt = {tuple(r) for r in automaton.tag_documents(df, "k", "t", phrases.where("tag is not null"), max_phrases=1).collect()}
    assert fast == dealt and len(fast) > 100
    assert {tuple(r) for r in tagging.dictionary_matches(df, "k", "t", phrases.where("tag is not null")).collect()} == fast
    assert automaton.tag_documents(df, "k", "t", phrases.limit(0)).count() == 0


def test_shares_equal_the_automaton(spark, monkeypatch):
    rng = random.Random(5)
    signs = ["a", "b", "c", "A.", "b,", "...", "é", "(c)", "x\xa0y"]
    rows = [(rng.choice([i, None, 7]), "".join(rng.choice(signs) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    long = [rng.choice("ab") for _ in range(40)]
    df = spark.createDataFrame([*rows, *rows[:20], (900, None), (901, ""), *[(i, "q " * i + " ".join(long + long)) for i in range(20)]], "k int, t string")
    named = [(" ".join(rng.choice(signs) for _ in range(rng.randint(1, 6))), rng.choice(["X", "Y\n"])) for _ in range(40)]
    named += [(" ".join(long[:n]), f"L{n}") for n in range(7, 41, 3)] + [(" ".join(long[2:n]), f"M{n}") for n in range(9, 33)]
    phrases = spark.createDataFrame([*named, ("", "X"), ("a", None)], "phrase string, tag string")
    fast = Counter(tuple(r) for r in automaton.tag_documents(df, "k", "t", phrases).collect())
    assert len(fast) > 1000 and any(r[0] is None for r in fast) and {"L40", "M32"} & {r[4] for r in fast}
    assert Counter(tuple(r) for r in automaton.tag_documents(df, "k", "t", phrases, max_phrases=1).collect()) == fast
    held = automaton.dictionary(phrases)   # many small shares, filters that let nearly everything through
    assert Counter(tuple(r) for r in large_dictionary.tag_by_shares(df, "k", "t", held, 2_000, 16).collect()) == fast
    for name, value in (("_SLICE_WORDS", 4), ("_PIECE", 300), ("_QUESTIONS", 50), ("_FORMS", 3)):
        monkeypatch.setattr(large_dictionary, name, value)
    sent = large_dictionary._filters(large_dictionary._keyed(held, 3), {k: 64 for k in [*range(1, 9), 16, 32]})
    whole = large_dictionary._keyed(held, 3).collect()
    assert all(large_dictionary._maybe(sent[r.k], np.array([r.h]).view(np.uint64)).all() for r in whole)


def test_shares_take_equal_digests_apart(monkeypatch):
    monkeypatch.setattr(large_dictionary._Digests, "_mixed", staticmethod(lambda sums: sums * np.uint64(0)))
    share = large_dictionary._Share(["a b", "b c", "b", "a b c d", "c"], list("VWXYZ"))
    piece = large_dictionary._Piece(["A, b c", None, "b c", "...", "c a b"], share.forms.known, share.forms.hashes)
    begins, ends, found = share.hits(piece)
    assert [(b, e, share.tags[p]) for b, e, p in zip(begins, ends, found)] == [(0, 2, "V"), (2, 3, "Z"), (3, 5, "W"), (6, 7, "Z"), (7, 9, "V")]


def test_a_large_dictionary_sends_no_words(spark):
    """The texts are shuffled once and whole, beside packed questions: no row for a word or a word group."""
    rng = random.Random(3)
    rows = [(i, " ".join("w%d" % rng.randint(0, 5_000) for _ in range(400))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t string")
    phrases = spark.createDataFrame([(" ".join(t.split(" ")[i:i + 3]), "P") for _, t in rows for i in range(0, 30, 3)], "phrase string, tag string")
    found = automaton.tag_documents(df, "k", "t", phrases, max_phrases=1)
    assert found.count() >= 3_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan


def test_first_words_of_a_text(spark):
    forms = ["a", "b", "...", "C.", ",", "(d", "é"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(forms) + rng.choice([" ", "  ", "\n", " \t", "\r"]) for _ in range(rng.randint(0, 70))) for _ in range(300)]
    texts += ["... " * 200 + "a b", " ".join(["a"] * 28), " ".join(["x"] * 27) + " ...", "", " ", ".", " . ", "a ", " a", ". a", "a .", None, ". " * 30_000 + "z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    want = [[f for f in (w.translate(str.maketrans("", "", ".,;:!?()")).lower() for w in re.split("[ \n\t\r]+", t or "")) if f][:27] for t in texts]
    got = {r.k: r.forms for r in df.select("k", queries_state.first_forms(F.col("text"), 27).alias("forms")).collect()}
    assert [got[i] or [] for i in range(len(texts))] == want


def test_cases_at_equal_places_are_one_line_each(spark):
    rows = [(1, 0, "CAR", "c1", f"n{i}", f"u{i}", None) for i in range(4)] + [(1, 0, "CAR", None, "n9", "u9", None)]
    entities = spark.createDataFrame(rows, "doc_order long, span_pos int, category string, court_id string, "
                                     "case_name string, absolute_url string, thing_searched string")
    cases = digest.digest_cases(entities)
    for most in (digest.LINES_IN_A_TASK, 2):
        lines = digest.numbered_lines(cases, most).select("court", "case_name", "line_no").collect()
        assert sorted(tuple(r) for r in lines) == [("", "n9", 1), *[("c1", f"n{i}", i + 1) for i in range(4)]]
    sections = digest.court_sections(cases, lines_per_part=3).collect()
    assert sorted((r.court_id, r.part_no, r.n_lines) for r in sections) == [("", 0, 1), ("c1", 0, 3), ("c1", 1, 1)]


def test_broken_snapshots_read(spark, tmp_path):
    item = "<item><title>1:21-sw-{0} x</title><link>h?1</link><description>[A] (b)</description><guid>g{0}</guid></item>"
    for court, text in {"aa": f"<channel>{item.format(1)}</channel>", "bb": f"<channel>{item.format(2)}{item.format(3)[:40]}", "cc": "<channel></channel>"}.items():
        (tmp_path / f"court={court}").mkdir()
        (tmp_path / f"court={court}" / "f.xml").write_text(text)
    entries = feeds.read_feed_snapshots(spark, str(tmp_path))
    assert sorted(r.guid for r in feeds.whole_entries(entries).collect()) == ["g1", "g2"]
    aside = feeds.feed_quarantine(entries).where("rule = 'snapshot'").collect()
    assert [(r.court, r.text[:15]) for r in aside] == [("bb", "<channel><item>")]
    assert feeds.normalise_entries(entries).count() == 2


def test_training_takes_nulls_and_unknown_words(spark, tmp_path):
    rows = [(f"good fine word{i}", 1) for i in range(30)] + [(f"bad poor word{i}", 0) for i in range(30)] + [(None, 0), ("", 1), ("good", None)]
    training.train(spark.createDataFrame(rows, "text string, label int"), "text", str(tmp_path / "m"), features=1 << 10)
    asked = spark.createDataFrame([(1, "good FINE day"), (2, "bad"), (3, None), (4, "unknown")], "doc_id int, text string")
    got = {r.doc_id: (r.predicted_class, r.likelihood) for r in training.trained_score(spark, str(tmp_path / "m"), asked, "text").collect()}
    assert got[1][0] == 1 and got[2][0] == 0 and len(got) == 4 and all(0 <= p <= 1 for _, p in got.values())


def test_batches_of_a_run_do_not_grow_with_its_files(spark, tmp_path):
    for files, taken in ((3, 2), (8, 2), (21, 6)):
        path = str(tmp_path / f"landed{files}")
        spark.range(100).repartition(files).write.parquet(path)
        assert ingest.files_per_batch(spark, path, 2) == taken
        batches = []
        stream = _stream(spark, path).writeStream.foreachBatch(lambda batch, number: batches.append(batch.count()))
        stream.option("checkpointLocation", str(tmp_path / f"offsets{files}")).trigger(availableNow=True).start().awaitTermination()
        assert sum(batches) == 100 and len(batches) <= ingest.RUN_BATCHES


def test_versions_without_partitions_are_removed(spark):
    table = _warehouse(spark).table("courtlistener_predictions")
    for turn in range(3):
        rows = log_rows(spark, [f"u{i}" for i in range(30)], turn == 2)
        table.replace(rows, table.partitions_of(rows))
    assert len(file_names(spark, f"{table.location()}/_versions")) == 1
    some = rows.where(F.substring(F.md5("absolute_url"), 1, 1) < "8")
    table.replace(some, table.partitions_of(some))
    assert len(file_names(spark, f"{table.location()}/_versions")) == 2   # the older one still holds the other partitions
    assert held(table) == [(a, True) for a in sorted(f"u{i}" for i in range(30))]


def test_automaton_takes_three_steps_a_word():
    names = [f"{'long' * 10}{i}" for i in range(300)]
    phrases = [(f"{a} {b}", "P") for a, b in zip(names, names[1:])] + [(names[0], "Q"), (f"{names[7]}  {names[9]}", "R")]
    made = automaton.Automaton(iter(phrases))
    assert made._trie.get_stats()["nodes_count"] <= 3 * 2 * len(phrases)
    assert made.tag(f"x {names[0]}, {names[1]} {names[7].upper()} , {names[9]}") == [
        (1, 3, f"{names[0]}, {names[1]}", "P"), (3, 6, f"{names[7].upper()} , {names[9]}", "R")]


def test_tags_of_a_large_batch_go_out_in_pieces():
    held = pd.Series([np.array([0, 2], "int32")] * 700 + [None])
    tags = spans._biluo.func(iter([(held, held + 1, held.map(lambda a: None if a is None else a[:1]),
                                    held.map(lambda a: None if a is None else a[:1] + 1), pd.Series([["x"]] * 701))]))
    ends = spans._running_ends.func(iter([held]))
    hits = spans._marker_hits(("a", "b")).func(iter([pd.Series([np.array(["a", "b", "c"], object)] * 700 + [None])]))
    for made, first in ((tags, ["U-x", "O"]), (ends, [0, 3]), (hits, [False, True, False])):
        pieces = list(made)
        assert [len(p) for p in pieces] == [256, 256, 189]
        assert list(pieces[0].iloc[0]) == first and pieces[-1].iloc[-1] is None


def test_ingest_parses_a_batch_once_before_its_upsert(spark, tmp_path, monkeypatch):
    rows = [("1:21-cr-00001 USA v. A &amp; B", "https://x?7", "[Order]", "g", "Mon, 07 Jun 2021 19:09:30 GMT", "c1")]
    fields = "title string, link string, description string, guid string, published string, court string"
    landed = str(tmp_path / "landed")
    spark.createDataFrame(rows, fields).withColumn("scrape_date", F.lit("2021-06-08").cast("timestamp_ntz")).write.parquet(landed)
    plans, plain = [], state.upsert_docket

    def noted(table, batch, position):
        plans.append(batch._jdf.queryExecution().toString())
        plain(table, batch, position)
    monkeypatch.setattr(state, "upsert_docket", noted)
    target = _warehouse(spark).table("rss_docket_entries")
    ingest.start_ingest(_stream(spark, landed), target, str(tmp_path / "aside"), str(tmp_path / "offsets")).awaitTermination()
    assert len(plans) == 1 and "html_unescape" not in plans[0]
    assert [tuple(r) for r in target.read().select("case_name", "pub_date").collect()] == [
        ("USA v. A & B", dt.datetime(2021, 6, 7, 19, 9, 30))]


def test_words_are_counted_where_their_texts_are(spark):
    texts = spark.createDataFrame([(1, "a b, a"), (1, "a"), (2, "B"), (3, None), (None, "a")], "k long, text string")
    counts = scoring.word_counts(texts, "k", "text")
    assert {tuple(r) for r in counts.collect()} == {(1, "a", 3), (1, "b", 1), (2, "b", 1), (None, "a", 1)}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "k long, label int")
    scored = scoring.bayes_score(counts, scoring.bayes_weights(scoring.class_counts(counts, labels, "k")), "k", 0.0)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "hashpartitioning(k#" in dealt[0] and "word" not in dealt[0]
    assert {(r["k"], r["predicted_class"]) for r in scored.collect()} == {(1, 1), (2, 0), (None, 1)}


def test_runs_over_two_parts_make_the_docket_once(spark, monkeypatch):
    landed, plain = [], queries_streaming._landed

    def noted(df, label):
        landed.append(" ".join(df.inputFiles()))
        return plain(df, label)
    monkeypatch.setattr(queries_streaming, "_landed", noted)
    queries_streaming.log_after_restart(spark, "/root/testdata/sf0.001")
    assert len(landed) == 2 and not any("orders.parquet" in files for files in landed)


def test_entries_that_land_twice_are_parsed_once(spark, tmp_path, monkeypatch):
    day = dt.datetime(2021, 6, 1)
    spark.createDataFrame([(1, "Ann", 3), (2, None, 4)], "c_custkey long, c_name string, c_nationkey int") \
        .write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(3, 1, "O", day, "1-URGENT"), (7, 1, "O", day, "2-HIGH"), (50, 2, "F", day, "5-LOW"), (11, None, "O", day, None)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    landed, plain = [], queries_state._landed
    monkeypatch.setattr(queries_state, "_landed", lambda df, label: landed.append(df) or plain(df, label))
    found = queries_state.stream_docket_repeats(spark, str(tmp_path))
    assert {(r.case_number, r.case_name, r.scrape_date) for r in found.collect()} == {
        ("1:21-sw-00001", "USA v. Ann", day + dt.timedelta(days=1, seconds=7)), ("1:21-sc-00002", None, day + dt.timedelta(days=1, seconds=50))}
    assert sorted((r.scrape_date - day).total_seconds() for r in landed[0].select("scrape_date").collect()) \
        == sorted(86400 * d + s for d in (1, -1) for s in (3, 7, 50))
    assert landed[0]._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_purge_writes_only_what_it_keeps(spark, monkeypatch):
    target = _warehouse(spark).table("rss_docket_entries")
    day, later = dt.datetime(2021, 6, 1), dt.datetime(2021, 7, 1)
    keys = spark.createDataFrame([("1", day), ("2", day), (None, day), ("3", later), ("4", dt.datetime(2021, 8, 1))],
                                 "case_number string, pub_date timestamp_ntz")
    entries = keys.select(*[F.col(f.name) if f.name in schemas.DOCKET_KEY else F.lit(None).cast(f.dataType).alias(f.name)
                            for f in schemas.DOCKET.fields])
    target.replace(entries, target.partitions_of(entries))
    written, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: written.append(path) or plain(self, path, *a, **k))
    state.purge_docket(target, keys.where(F.col("case_number").isin("1", "3")))
    assert sorted((r.case_number, r.pub_date) for r in target.read().collect()) == [("1", day), ("3", later)]
    assert len(written) == 1 and "_versions" in written[0]


def test_candidates_of_a_batch_meet_the_known_once(spark, tmp_path, monkeypatch):
    before, at, later = dt.datetime(2021, 5, 1), dt.datetime(2021, 6, 1), dt.datetime(2021, 7, 1)
    rows = [("a", later, "Warrant"), ("a", later, "warrant"), ("b", later, "Warrant"), ("c", before, "Warrant"), ("d", at, "Warrant"),
            ("e", later, None), ("f", None, "Warrant"), (None, later, "Warrant"), ("g", later, "Order"), ("h", later, "Unseal")]
    path = str(tmp_path / "landed")
    for part in (rows[:4], rows[4:], rows[:3], rows[:3] + [("i", later, "Warrant")]):
        spark.createDataFrame(part, "case_number string, pub_date timestamp_ntz, document_type string").coalesce(1) \
            .write.mode("append").parquet(path)
    known = spark.createDataFrame([("b", later, "swornot"), ("b", later, "swornot"), ("c", before, "swornot"), ("h", None, "swornot"),
                                   (None, later, "swornot"), ("a", later, "other")],
                                  "case_number string, pub_date timestamp_ntz, prediction_type string")
    plans, stored, append, write = [], [], Table.append, DataFrameWriter.parquet
    monkeypatch.setattr(Table, "append", lambda self, rows, key: plans.append(
        rows._jdf.queryExecution().optimizedPlan().toString()) or append(self, rows, key))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to, *a, **k: stored.append(to) or write(self, to, *a, **k))
    warehouse = _warehouse(spark)
    alerts.start_candidates(_stream(spark, path), known, dt.date(2021, 6, 1), warehouse, str(tmp_path / "offsets")).awaitTermination()
    logged = [(r.case_number, r.pub_date) for r in warehouse.table("predictions").read().collect()]
    assert sorted(logged, key=str) == sorted([("a", later), (None, later), ("h", later), ("i", later)], key=str)
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)
    months = [to for to in stored if "/known-" in to]
    assert len(months) == 1 and [n for n in file_names(spark, months[0]) if "=" in n] == ["pub_month=2021-07"]
