"""Side hits, adapters and packages."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import side_hits
from foliant.plans.search_plan import Planner
from foliant.sources import adapters, package


def test_side_hits(spark):
    p = Planner()
    cards = spark.createDataFrame([(1, 1, "目录", "第一章 歷史導論"), (2, 1, "學", "x"), (3, 2, "y", "z")], "id int, doc_id int, title string, content string")
    assert [r.id for r in side_hits.card_hits(cards, p, "历史导论").collect()] == [1]
    assert [r.id for r in side_hits.card_hits(cards, p, "学").collect()] == [2]
    wiki = cards.withColumn("slug", F.lit("s"))
    assert [r.id for r in side_hits.wiki_hits(wiki, p, "历史").collect()] == [1]
    ents = spark.createDataFrame([(1, "歷史"), (2, "b")], "id int, canonical string")
    names = ents.select(F.col("id").alias("entity_id"), F.col("canonical").alias("name"))
    m = spark.createDataFrame([(1, True), (1, False)], "entity_id int, valid boolean")
    assert [(r.entity_id, r.mentions) for r in side_hits.entity_hits(ents, names, m, p, "历史").collect()] == [(1, 1)]
    notes = spark.createDataFrame([(1, 1, 3, "学 note", "clip", 5), (2, 1, 3, None, None, 6)], "id int, doc_id int, page_num int, note string, clip_text string, updated_at int")
    docs = spark.createDataFrame([(1, "t")], "id int, title string")
    assert [r.id for r in side_hits.annotation_hits(notes, docs, p, "學").collect()] == [1]
    assert side_hits.page_notes(notes).first().notes == "「clip」 → 学 note"


def test_entity_filters(spark):
    e = spark.createDataFrame([(1, {"era": "清末", "year_start": "1890", "year_end": "1911"}), (2, {"朝代": "清"}), (3, None)], "id int, props map<string,string>")
    ids = lambda **k: sorted(r.id for r in side_hits.filtered_entities(e, **k).collect())
    assert ids(era="清") == [1, 2] and ids(year=1900) == [1] and ids(year=1912) == ids(year=1889) == [] and ids() == [1, 2, 3]


def test_retries():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("no")
        return "ok"

    assert adapters.with_retries(flaky, "q", sleep=waits.append) == "ok" and waits == [1.0, 2.0]

    def busy(x):
        calls.append(x)
        raise adapters.Busy

    calls.clear()
    with pytest.raises(adapters.Busy):
        adapters.with_retries(busy, "q", tries=9, sleep=waits.append)
    assert len(calls) == 2


def test_failures_are_rows(spark):
    def adapter(x):
        if x == "scan":
            raise adapters.NeedsOcr("no text")
        if x == "bad":
            raise ValueError("bad")
        return x.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "scan")], "id int, req string")
    got = {r.id: (r.answer, r.status) for r in adapters.call(rows, adapter, "req", ["id"], tries=1).collect()}
    assert got == {1: ("A", "done"), 2: (None, "error"), 3: (None, "needs_ocr")}
    lines = spark.createDataFrame([(1, " ", "x"), (2, "t", "x")], "id int, trans string, gloss string")
    assert [r.id for r in adapters.blank_rows(lines, ["trans", "gloss"]).collect()] == [1]


def test_package_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "k1", "f1"), (2, "k2", "f2")], "id long, cite_key string, filename string")
    lines = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    log = spark.createDataFrame([(1, 1, 1, "a", "b", 1), (1, 1, 2, "c", "d", 0), (2, 1, 1, "e", "f", 1)], "doc_id long, page_num int, block_num int, old_value string, new_value string, in_pkg int")
    tables = {"documents": docs, "lines": lines, "revision_log": log}
    package.export_documents(tables, docs.filter("id = 1"), str(tmp_path / "p"))
    come = package.read_package(spark, str(tmp_path / "p"), list(tables))
    other = {"documents": docs.filter("id = 2"), "lines": lines.filter("doc_id = 2"), "revision_log": log.filter("doc_id = 2")}
    both = package.merge_package(other, come)
    assert sorted((r.id, r.cite_key) for r in both["documents"].collect()) == [(2, "k2"), (3, "k1")]
    assert sorted((r.doc_id, r.text) for r in both["lines"].collect()) == [(2, "b"), (3, "a")]
    package.export_documents(tables, docs.filter("id = 1"), str(tmp_path / "c"), changeset=True)
    change = package.read_package(spark, str(tmp_path / "c"), ["documents", "revision_log"])
    assert change["revision_log"].count() == 1
    assert package.attach_changeset(tables, change).count() == 3
    assert package.orphans({"documents": docs.filter("id = 1"), "lines": lines}).first().doc_id == 2
    assert spark.read.json(str(tmp_path / "p/manifest")).first().base_version == 2


def test_names_and_config():
    assert package.valid_name("晚清 志") and not any(map(package.valid_name, ["", ".x", "a/b", " a", "a ", "x" * 65]))
    assert package.read_config('{"a": 1, "z": 2}', {"a": 0, "b": 0}) == {"a": 1, "b": 0} and package.read_config("{", {"a": 0}) == {"a": 0}


def test_clicks_join_searches_in_a_stream(spark, tmp_path):
    import datetime as dt

    from foliant.streaming import intake

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    first, last = [(1, "a", at(0)), (2, "b", at(0, 1))], [(3, "c", at(9))]
    for n, (e, c) in enumerate(((first, [(1, at(0, 10)), (1, at(0, 11))]), (last, [(9, at(9))]))):
        spark.createDataFrame(e, "id long, query string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        spark.createDataFrame(c, "event_id long, clicked_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        events = spark.readStream.schema("id long, query string, ts timestamp").parquet(str(tmp_path / "e"))
        clicks = spark.readStream.schema("event_id long, clicked_at timestamp").parquet(str(tmp_path / "c"))
        q = intake.click_log(events, clicks).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.id: r.clicked for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] is True and got[2] is False


def test_scan_status(spark, tmp_path):
    from foliant.streaming import intake

    v = spark.createDataFrame([("s", "a", "new"), ("s", "b", "failed"), ("s", "c", "unstable"), ("t", "d", "duplicate")], "collection string, name string, verdict string")
    intake.keep_status(str(tmp_path / "status"))(v, 0)
    intake.keep_status(str(tmp_path / "status"))(v, 0)
    got = {r.collection: (r.new_files, r.failed_files, list(r.failed_names), r.batch) for r in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert got == {"s": (1, 1, ["b"], 0), "t": (0, 0, [], 0)}
