"""File readers and writers, and whole alert runs."""

import json

from pyspark.sql import functions as F

from docketflow import schemas
from docketflow.plans import adapters, feed_alert, search_alert
from docketflow.plans.queries_alerts import feed_scorer, feed_tagger, search_scorer, search_tagger
from docketflow.plans.queries_streaming import _warehouse
from docketflow.plans.queries_feed import START
from docketflow.session import scratch_path
from docketflow.sources import artifacts, corpora, search_results, tabular
from docketflow.streaming.alerts import run_feed, start_feed_alert

FOLDER = "/root/testdata/sf0.001"


def write_pages(folder, names):
    for k, name in enumerate(names, 1):
        results = [{"absolute_url": f"/d/{k}/{i}/", "caseName": "x", "court_id": "c", "description": "d", "other": 1}
                   for i in range(20)]
        body = {"results": results, "next": None} if k < 4 else {"detail": "throttled"}
        (folder / name).write_text(json.dumps(body, indent=1))


def test_search_pages_are_capped_by_page(spark, tmp_path):
    write_pages(tmp_path, [f"page_{k}.json" for k in range(1, 5)])
    # The cap is met exactly after two pages, which still lets a third one in.
    assert search_results.read_capped(spark, str(tmp_path), 40).count() == 60
    assert search_results.read_capped(spark, str(tmp_path), 39).count() == 40
    assert search_results.read_capped(spark, str(tmp_path)).count() == 60


def test_pages_without_a_number_are_read_last(spark, tmp_path):
    write_pages(tmp_path, ["first.json", "page_7.json", "other.json"])
    (tmp_path / "first.json").write_text(json.dumps({"results": [{"absolute_url": "/a/"}], "next": "http://h/?page=2&x=1"}))
    pages = search_results.read_search_pages(spark, str(tmp_path))
    assert sorted(r.page_no for r in pages.collect())[:2] == [1, 7]
    assert search_results.unnumbered_pages(pages).count() == 1
    assert search_results.read_capped(spark, str(tmp_path)).count() == 41
    assert search_results.read_capped(spark, str(tmp_path), 1).count() == 21


def test_csv(spark, tmp_path):
    (tmp_path / "labels.csv").write_text('token,label\n"a ""b"", c",online account\nx,car\nx,bag\n')
    rows = tabular.read_token_labels(spark, str(tmp_path / "labels.csv")).collect()
    assert {(r.token, r.label) for r in rows} == {('a "b", c', "ONLINE_ACCOUNT"), ("x", "BAG")}
    (tmp_path / "sw.csv").write_text(",case_name,document_type,case_number,court,is search warrant?\n"
                                     '0,"USA v. A, B",Warrant &#167;,9:21-sw-1,dcd,True\n')
    row = tabular.read_labelled_dockets(spark, str(tmp_path / "sw.csv")).first()
    assert (row.row_no, row.case_name, row.is_search_warrant) == (0, "USA v. A, B", True)
    out = str(tmp_path / "out")
    tabular.write_csv(spark.createDataFrame([('q "r", s', "")], "token string, label string"), out)
    assert tabular.read_csv(spark, out, schemas.TOKEN_LABEL).first().token == 'q "r", s'


def test_annotations_and_listing(spark, tmp_path):
    example = {"text": "a b", "tokens": [{"text": "a", "start": 0, "end": 1, "id": 0}], "answer": "accept", "x": 1}
    (tmp_path / "a.jsonl").write_text(json.dumps(example) + "\n")
    row = corpora.read_annotations(spark, str(tmp_path / "a.jsonl")).first()
    assert row.spans is None and row.tokens[0].end == 1 and len(row.sent_id) == 32
    held = tmp_path / "models" / "models" / "flairner"
    held.mkdir(parents=True)
    (held / "best-model.pt").write_bytes(b"x")
    manifest = spark.createDataFrame([("models/flairner/best-model.pt",), ("models/other.txt",)], "artifact string")
    missing = artifacts.missing_files(spark, manifest, str(tmp_path / "models")).collect()
    assert [r.artifact for r in missing] == ["models/other.txt"]


def test_streamed_feed_alert_equals_batch_and_replays(spark):
    docket = adapters.docket(spark, FOLDER).drop_duplicates(schemas.DOCKET_KEY)
    path, root, warehouse = scratch_path(spark, "docket"), scratch_path(spark, "alerts"), _warehouse(spark)
    docket.repartition(2).write.parquet(path)
    stored = spark.read.parquet(path)
    none = spark.createDataFrame([], schemas.CLASS_LOG)
    expected = feed_alert.run(stored, none, START, "entry_id", feed_scorer, feed_tagger)
    for _ in range(2):   # the second pass starts over and finds everything logged
        stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
        start_feed_alert(stream, START, "entry_id", feed_scorer, feed_tagger, warehouse, root,
                         scratch_path(spark, "offsets")).awaitTermination()
        log = warehouse.table("predictions").read()
        assert log.count() == expected.class_log.count() == log.select("log_key").distinct().count()
    assert warehouse.table("ner_predictions").read().count() == expected.entity_log.count()


def test_replayed_batch_writes_the_same_outbox(spark):
    """A batch that failed after its log was written is scored from what it stored, and not found empty."""
    docket = adapters.docket(spark, FOLDER)
    root, warehouse = scratch_path(spark, "alerts"), _warehouse(spark)
    for _ in range(2):
        assert feed_alert.publish(docket, warehouse, START, "entry_id", feed_scorer, feed_tagger, root, "run", 0)
        outbox = spark.read.parquet(f"{root}/outbox/run=run/batch_id=0").collect()
        assert outbox and sum(r.n_blocks for r in outbox) > 2
    assert not feed_alert.publish(docket, warehouse, START, "entry_id", feed_scorer, feed_tagger, root, "run", 1)


def test_empty_run_purges_nothing(spark):
    warehouse = _warehouse(spark)
    entries = adapters.docket(spark, FOLDER).select(*schemas.DOCKET.names) \
        .where(~F.col("document_type").ilike("%warrant%") & ~F.col("document_type").ilike("%unseal%"))
    path = scratch_path(spark, "entries")
    entries.write.parquet(path)
    stream = spark.readStream.schema(entries.schema).parquet(path)
    run_feed(stream, START, feed_scorer, feed_tagger, warehouse, scratch_path(spark, "alerts"), scratch_path(spark, "offsets"))
    held = warehouse.table("rss_docket_entries").read()
    assert held.count() == entries.select(*schemas.DOCKET_KEY).distinct().count() > 0


def test_published_search_alert(spark):
    root, warehouse = scratch_path(spark, "search"), _warehouse(spark)
    results = adapters.search_results(spark, FOLDER)
    assert search_alert.publish(results, warehouse, search_scorer, search_tagger, root, "a", 0)
    assert warehouse.table("courtlistener_predictions").read().count() == results.count()
    assert not search_alert.publish(results, warehouse, search_scorer, search_tagger, root, "b", 0)
    report = spark.read.json(f"{root}/report/run=a/batch_id=0")
    body = json.loads(report.where(F.col("category") == "BAG").first().body)
    assert list(body) == sorted(body)


def test_numbered_token_labels_in_many_files(spark, tmp_path):
    """The number counts, whatever file a row is in."""
    for name, line in (("a", "Ann,JUDGE,2"), ("b", "Ann,COURT,1")):
        (tmp_path / f"{name}.csv").write_text(f"token,label,row_no\n{line}\n")
    assert [tuple(r) for r in tabular.read_token_labels(spark, str(tmp_path), numbered=True).collect()] == [("Ann", "JUDGE")]
