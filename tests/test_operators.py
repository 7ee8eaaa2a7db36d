"""Entities, layout, changes, statistics and streams on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.functions.text import normalise
from foliant.operators import collate, entities, layout, mutate, stats
from foliant.plans import catalog
from foliant.streaming import intake
from tests.conftest import SF

ENT = "id long, canonical string, aliases array<string>, ext_ids map<string,string>"


@pytest.fixture(scope="module")
def ents(spark):
    return spark.createDataFrame([(1, "王明", ["王 明珂", "wm"], {"a": "1"}), (2, "王明珂", ["wm"], {"a": "2", "b": "3"}), (3, "考据考据", None, None)], ENT)


def test_resolution_prefers_names_then_least_alias(spark, ents):
    got = {r.surface: (r.entity_id, r.how) for r in entities.resolve(spark.createDataFrame([("王明珂",), ("wm",), ("x",)], "surface string"), ents).collect()}
    assert got == {"王明珂": (2, "name"), "wm": (1, "alias"), "x": (None, "none")}


def test_new_entities_are_numbered_by_first_place(spark, ents):
    seen = spark.createDataFrame([("b", 2, 0), ("a", 1, 5), ("c", 1, 2), ("wm", 0, 0)], "surface string, doc_id long, pos int")
    got = {r.surface: r.entity_id for r in entities.with_new_entities(entities.resolve(seen, ents), seen, 3).collect()}
    assert got == {"wm": 1, "c": 4, "a": 5, "b": 6}


def test_seeds_mentions_and_anchors(spark):
    seeds = spark.createDataFrame([(1, "甲 乙", 0), (1, "甲乙", 1), (1, "丙", 2)], "doc_id long, surface string, pos int")
    assert [r.pos for r in entities.distinct_seeds(seeds).orderBy("pos").collect()] == [0, 2]
    blocks = spark.createDataFrame([(1, p, 1, "x甲 乙丙") for p in range(1, 26)], "doc_id long, page_num int, block_num int, index_text string")
    m = entities.anchor_mentions(seeds.filter("pos <> 0"), blocks)
    assert m.filter("surface = '甲乙'").count() == 20
    assert [tuple(r) for r in m.filter("surface = '丙'").collect()] == [(1, "丙", None, None)]
    kept = entities.still_anchored(m.filter("page_num IS NOT NULL").withColumn("id", F.monotonically_increasing_id()), blocks)
    assert kept.filter("anchor_ok").count() == 20


def test_reanchor_takes_the_first_line(spark):
    m = spark.createDataFrame([(1, 1, 1, 9, "ab"), (2, 1, 1, 9, "zz")], "id long, doc_id long, page_num int, block_num int, surface string")
    lines = spark.createDataFrame([(11, 1, 1, 3, "xx ab"), (10, 1, 1, 2, "ab")], "id long, doc_id long, page_num int, block_num int, text string")
    assert {r.id: r.block_num for r in entities.reanchor(m, lines).collect()} == {1: 2, 2: 9}


def test_audits(ents):
    assert [r.id for r in entities.audit_repeats(ents).collect()] == [3]
    assert [(r.inner_id, r.outer_id) for r in entities.audit_contained(ents).collect()] == [(1, 2)]


def test_merging_entities(spark, ents):
    mentions = spark.createDataFrame([(1, 1, 1, 1, 1, "s"), (2, 2, 1, 1, 1, "s"), (3, 1, 1, 2, 1, "s")], "id long, entity_id long, doc_id long, page_num int, block_num int, surface string")
    e, m = entities.merge_entity(ents, mentions, 1, 2)
    row = e.filter("id = 2").first()
    assert row.aliases == ["wm", "王明", "王 明珂"] and row.ext_ids == {"a": "2", "b": "3"} and e.count() == 2
    assert sorted((r.id, r.entity_id) for r in m.collect()) == [(1, 2), (3, 2)]


def test_regions_and_reading_order(spark):
    b = spark.createDataFrame([(1, 1, 1, [0.0, 0.0, 10.0, 10.0]), (1, 1, 2, [5.0, 0.0, 15.0, 10.0]), (1, 1, 3, None), (1, 1, 4, [30.0, 0.0, 40.0, 10.0])], "doc_id int, page_num int, block_num int, bbox array<double>")
    r = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 10.0, 20.0], "v_rtl"), (1, 1, 1, [0.0, 0.0, 50.0, 20.0], "h")], "doc_id int, page_num int, region_idx int, bbox array<double>, direction string")
    assert {x.block_num: x.region_idx for x in layout.assign_regions(b, r).collect()} == {1: 0, 2: 0, 4: 1}
    assert [x.block_num for x in layout.reading_order(b, r).orderBy("new_block").collect()] == [2, 1, 4, 3]
    assert {x.block_num for x in layout.selected(b.withColumns({"page_w": F.lit(100), "page_h": F.lit(100)}), 0.0, 0.0, 0.1, 0.05).collect()} == {1, 2}


def test_rectangles_and_templates(spark):
    one = lambda *v: spark.range(1).select(layout.valid_rect(*map(F.lit, v)).alias("r")).first().r
    assert one(0.5, 0.5, 0.5005, 0.2).w == 0.5 and one(0.5, 0.5, 0.6, 0.2) is None and one(-0.1, 0.0, 0.1, 0.1) is None
    r = spark.createDataFrame([(0, [0.0, 0.0, 50.0, 100.0], "h"), (1, [0.0, 0.0, 0.2, 100.0], "h")], "region_idx int, bbox array<double>, direction string")
    pages = spark.createDataFrame([(2, 200.0, 100.0)], "page_num int, page_w double, page_h double")
    assert [(x.region_idx, x.bbox) for x in layout.apply_template(r, 100.0, 100.0, pages).collect()] == [(0, [0, 0, 100, 100])]


def test_line_order(spark):
    rows = [(1, i, [float(x), float(y), float(x + w), float(y + h)], 1000.0) for i, (x, y, w, h) in enumerate([(100, 0, 20, 400), (300, 0, 20, 400), (200, 0, 20, 400)])]
    rows += [(2, i, [float(x), float(y), float(x + 90), float(y + 20)], 1000.0) for i, (x, y) in enumerate([(200, 2), (0, 0), (0, 60)])]
    l = spark.createDataFrame(rows, "page int, id int, bbox array<double>, page_h double")
    got = layout.line_order(l).orderBy("page", "position").collect()
    assert [r.id for r in got if r.page == 1] == [1, 2, 0] and [r.id for r in got if r.page == 2] == [1, 0, 2]


def test_upserts_tags_and_removal(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "id int, v string, extra int")
    got = mutate.upsert(old, new, ["id"])
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(mutate.upsert(got, new, ["id"]).collect()) == sorted(got.collect())
    assert mutate.insert_ignore(old, new.union(new), ["id"]).count() == 3
    tags = lambda old, change, how: spark.range(1).select(mutate.set_tags(F.array(*map(F.lit, old)), change, how).alias("t")).first().t
    assert tags(["a"], ["b", "a"], "add") == ["a", "b"] and tags(["a"], ["a"], "remove") == ["primary"] and tags(["a"], ["b", "b"], "set") == ["b"]


def test_edits_are_logged(spark):
    lines = spark.createDataFrame([(1, 1, 1, 1, "a", "single_char"), (2, 1, 1, 2, "b", None)], "id int, doc_id int, page_num int, block_num int, text string, suspect string")
    new, log = mutate.edit_lines(lines, spark.createDataFrame([(1, "x"), (2, "b")], "id int, new_text string"))
    assert [(r.text, r.suspect) for r in new.orderBy("id").collect()] == [("x", None), ("b", None)]
    assert [(r.old_value, r.new_value) for r in log.collect()] == [("a", "x")]


def test_import_twice_is_once(spark):
    have = spark.createDataFrame([(5, "k1", "f1")], "id long, cite_key string, filename string")
    come = spark.createDataFrame([(1, "k1", "f9"), (7, "k2", "f1"), (2001, "k3", "f3"), (3, "k4", "f4")], "id long, cite_key string, filename string")
    once, ids = mutate.import_documents(have, come)
    assert sorted((r.id, r.cite_key) for r in once.collect()) == [(5, "k1"), (6, "k4"), (7, "k3")]
    assert sorted(mutate.import_documents(once, come)[0].collect()) == sorted(once.collect())
    kids = mutate.import_children(spark.createDataFrame([], "doc_id long, t string"), spark.createDataFrame([(3, "x"), (1, "y")], "doc_id long, t string"), ids)
    assert [tuple(r) for r in kids.collect()] == [(6, "x")]


def test_pages_replaced_and_appended(spark):
    s = "doc_id int, page_num int, block_num int, t string"
    old = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 4, "b")], s)
    new = spark.createDataFrame([(1, 2, 1, "c")], s)
    assert sorted(r.t for r in mutate.replace_pages(old, new).collect()) == ["a", "c"]
    assert sorted((r.block_num, r.t) for r in mutate.append_blocks(old, new).filter("page_num = 2").collect()) == [(4, "b"), (5, "c")]
    assert [r.block_num for r in mutate.dense_blocks(old).orderBy("page_num").collect()] == [1, 1]


def test_files_attach_by_priority(spark):
    d = spark.createDataFrame([(1, "l.pdf", "f.pdf"), (2, None, "f.pdf"), (3, None, "no")], "id int, linked_pdf string, filename string")
    f = spark.createDataFrame([("l.pdf", "p/l"), ("f.pdf", "p/f")], "name string, path string")
    assert {r.id: r.path for r in mutate.attach_files(d, f).collect()} == {1: "p/l", 2: "p/f", 3: None}


def test_staleness_integrity_quota(spark):
    st = stats.stale(spark.createDataFrame([(1, 1), (2, 0)], "doc_id int, base_edits int"), spark.createDataFrame([(1,), (1,)], "doc_id int"))
    assert {r.doc_id: r.stale for r in st.collect()} == {1: True, 2: False}
    d = spark.createDataFrame([("s", "a", False), ("s", "b", False), ("s", "v", True)], "collection string, filename string, original_virtual boolean")
    row = stats.integrity(d, spark.createDataFrame([("s", "a"), ("s", "z")], "collection string, filename string")).first()
    assert (row.docs, row.found, row.missing, row.virtual, row.orphans) == (3, 1, 1, 1, 1)
    q = spark.createDataFrame([(1, 100), (2, 60), (3, 50)], "doc_id int, missing_chars int")
    assert stats.quota_pools(q, {"a": 1.0, "b": 1.0}) == {1: "a", 2: "b", 3: "b"}


# --- streams ---------------------------------------------------------------------------


def run(stream, tmp_path, name, mode, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def stamp(s):
    return dt.datetime(2026, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)


def test_watching_a_folder(spark, tmp_path):
    rows = [("s", "a.pdf", 1, stamp(0), stamp(5)), ("s", "a.pdf", 1, stamp(0), stamp(90)), ("s", "a.pdf", 1, stamp(0), stamp(200)), ("s", ".hid.pdf", 1, stamp(0), stamp(200)), ("s", "b.part", 1, stamp(0), stamp(200)), ("s", "c.md", 1, stamp(199), stamp(200))]
    spark.createDataFrame(rows, intake.LISTING).write.parquet(str(tmp_path / "l"))
    got = run(intake.watch(spark.readStream.schema(intake.LISTING).parquet(str(tmp_path / "l"))), tmp_path, "watched", "append", spark)
    # Each once, however often it is listed; by now nobody has written to either for long.
    assert sorted((r.name, r.mtime) for r in got) == [("a.pdf", stamp(0)), ("c.md", stamp(199))]


def test_recognition_queue(spark, tmp_path):
    rows = [(1, 1, "error"), (1, 1, "done"), (1, 2, "error"), (1, 2, "error"), (1, 2, "error"), (1, 2, "done")]
    spark.createDataFrame(rows, "doc_id long, page_num int, outcome string").coalesce(1).write.parquet(str(tmp_path / "q"))
    got = run(intake.ocr_queue(spark.readStream.schema("doc_id long, page_num int, outcome string").parquet(str(tmp_path / "q"))), tmp_path, "ocr", "update", spark)
    assert {r.page_num: (r.status, r.tries) for r in got} == {1: ("done", 2), 2: ("error", 3)}
    states = spark.createDataFrame(got)
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_num int")
    assert [r.page_num for r in intake.pages_to_do(pages, states).collect()] == [2] and intake.pages_to_do(pages, states, resume=False).count() == 2
    assert intake.finished(pages, states).first().state == "done_with_errors"


def test_misses_as_a_stream(spark, tmp_path):
    rows = [("q", 0, stamp(1)), ("q", 0, stamp(9)), ("r", 3, stamp(2))]
    spark.createDataFrame(rows, "query string, total_docs int, ts timestamp").write.parquet(str(tmp_path / "e"))
    got = run(intake.misses(spark.readStream.schema("query string, total_docs int, ts timestamp").parquet(str(tmp_path / "e"))), tmp_path, "misses", "complete", spark)
    assert [(r["query"], r.hits, r.last_seen) for r in got] == [("q", 2, stamp(9))]


def test_vanished_files(spark):
    d = spark.createDataFrame([("s", "a", False), ("s", "b", False), ("s", "v", True)], "collection string, filename string, original_virtual boolean")
    assert [r.filename for r in intake.vanished(spark.createDataFrame([("s", "a")], "collection string, name string"), d).collect()] == ["b"]


def test_alignment_takes_every_document_whole(spark):
    got = catalog.collate.alignments(catalog._pairs(spark, SF)).filter("ca IS NOT NULL").groupBy(F.expr("id div 1000000").alias("doc_id")).count()
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.length(normalise(F.col("text"))).alias("n")).filter("n > 0")
    assert {(r.doc_id, r["count"]) for r in got.collect()} == {(r.doc_id, r.n) for r in d.collect()}


def test_import_lets_in_one_after_the_other(spark):
    have = spark.createDataFrame([(5, "k0", "f0")], "id long, cite_key string, filename string")
    come = spark.createDataFrame([(1, "k1", "f1"), (2, "k1", "f2"), (3, None, "f1"), (4, "k2", "f2"), (6, "k0", "f9"), (7, None, None), (8, "", "f0"), (9, "k3", "f3")], "id long, cite_key string, filename string")
    both, ids = mutate.import_documents(have, come)
    assert sorted((r.old_id, r.new_id) for r in ids.collect()) == [(1, 6), (4, 7), (7, 8), (9, 9)]
    assert both.count() == 5
    forced, ids = mutate.import_documents(have, come.filter("id = 8"), force=True)
    assert ids.count() == 1 and sorted(r.filename for r in forced.collect()) == ["f0", "f0_imported"]


def test_audit_ignores_white_space(spark):
    e = spark.createDataFrame([(1, "Li  Bai", ["x"]), (2, "other", ["LiBai", "LiBai"]), (3, "Li Bai the poet", [])], "id long, canonical string, aliases array<string>")
    assert [(r.alias_of, r.named) for r in entities.audit_alias_is_name(e).collect()] == [(2, 1)]
    assert [(r.inner_id, r.outer_id) for r in entities.audit_contained(e.withColumn("canonical", F.regexp_replace("canonical", " poet", ""))).collect()] == [(1, 3)]


def test_numbers_over_ranges(spark):
    from foliant.sources.scratch import numbered

    d = spark.range(0, 5000, 7).select((F.col("id") * 37 % 5003).alias("id"))
    got = {r.id: r.n for r in numbered(d, ["id"]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(got), 1)}


def test_quota_refuses_long_lists(spark):
    with pytest.raises(ValueError):
        stats.quota_pools(spark.range(4).select(F.col("id").alias("doc_id"), F.lit(1).alias("missing_chars")), {"a": 1.0}, most_jobs=3)


def test_purge_is_guarded(spark):
    from foliant.operators import curation

    d = spark.range(9).select("id", F.lit("s").alias("collection"), F.concat(F.lit("f"), "id").alias("filename"), F.lit(False).alias("original_virtual"))
    listing = spark.createDataFrame([("s", "f1")], "collection string, name string")
    with pytest.raises(curation.TooMany):
        curation.purge_missing({"documents": d}, listing, most=3)
    assert [r.id for r in curation.purge_missing({"documents": d}, listing, most=8)["documents"].collect()] == [1]


def test_metadata_makes_keys_anew(spark):
    from foliant.operators import curation

    row = "id long, collection string, filename string, cite_key string, title string, author string, lang string, tri_rows int, linked_pdf string, source_tags array<string>, bib_type string, bib_data map<string,string>"
    d = spark.createDataFrame([(1, "s", "a", "smith1999one", "One", "Smith", "eng", 1, None, ["primary"], "@book", {"author": "Smith", "year": "1999", "title": "One"}), (2, "s", "b", "old", "x", "y", "zh", 1, "files/1/a.pdf", ["primary"], None, {})], row)
    change = spark.createDataFrame([(1, None, None, "@article"), (2, {"author": "Smith", "year": "1999", "title": "One"}, "", None)], "id long, bib_data map<string,string>, linked_pdf string, bib_type string")
    got = {r.id: (r.cite_key, r.title, r.bib_type, r.linked_pdf) for r in curation.update_metadata(d, change).collect()}
    assert got == {1: ("smith1999one", "One", "@article", None), 2: ("smith1999oneb", "One", None, None)}


def test_page_check_is_idempotent(spark):
    l = spark.createDataFrame([(1, 1, 1, 1, 1, "甲乙丙丁戊", "vertical_text", None), (2, 1, 1, 1, 2, "己庚辛壬癸", "vertical_text", "diff,single_char"), (3, 1, 1, 2, 1, "三", "number", None), (4, 1, 2, 1, 1, "x", "table", "diff")], "id long, doc_id int, page_num int, block_num int, line_num int, text string, block_label string, suspect string")
    c = spark.createDataFrame([(1, 1, "甲乙丙子戊己庚辛壬癸"), (1, 2, "y")], "doc_id int, page_num int, b string")
    states, found, flagged = collate.check_pages(c, l)
    assert {(r.page_num, r.state) for r in states.collect()} == {(1, "done"), (2, "unsupported")}
    assert [list(r.line_ids) for r in found.collect()] == [[1]]
    flags = {r.id: r.suspect for r in flagged.collect()}
    assert flags == {1: "diff", 2: "single_char", 3: None, 4: "diff"}
    assert {r.id: r.suspect for r in collate.check_pages(c, flagged)[2].collect()} == flags


def test_long_names_are_searched_in_all_their_forms():
    from foliant.functions.text import highlight
    from foliant.plans.search_plan import Pattern, Planner

    name = "國學歷論據導"  # 64 forms
    assert isinstance(Planner().plan(name, ["another name"]).any_name[0], Pattern) and highlight(F.lit("国学历论据导"), Planner().highlight_terms(name)) is not None


def test_long_names_match(spark):
    from foliant.operators import search
    from foliant.plans.search_plan import Planner

    b = spark.createDataFrame([(1, "看国学历論据导看"), (2, "国学")], "doc_id int, index_text string").withColumn("trans", F.lit(None).cast("string"))
    assert [r.doc_id for r in b.filter(search.matches(Planner().plan("國學歷論據導", ["xyz"]))).collect()] == [1]
