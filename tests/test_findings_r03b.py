"""Faults that the driver's growth from 0.1 to 1 GB showed."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import collate
from foliant.plans import reading_catalog, registry, shelf_catalog, text_catalog, upkeep_catalog  # noqa: F401  the catalogues register their queries
from tests.conftest import SF, same_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first, cells", [(8, 1 << 23), (1, 3000)])
def test_bands_of_near_pairs_equal_the_whole_table(monkeypatch, first, cells):
    r = random.Random(first)
    points = lambda t: np.array([ord(c) for c in t], np.uint32)
    a, b = [], []
    for n in (0, 1, 2, 17, 60, 211):
        for letters in ("ab", "abcdefghijkl", "abcdefghijklmnopqrstuvwxyz"):
            for q in (0, 0.02, 0.1, 0.5, 1):
                x = "".join(r.choice(letters) for _ in range(n))
                y = "".join(c for k in x for c in ([r.choice(letters)] if r.random() < q else [k]) * (r.random() > q / 3)) + r.choice(["", "a", "bab"])
                a += [points(x), points(x)]
                b += [points(y), points(x.replace("e", "a"))]
    want = [collate.align_many([x], [y])[0] for x, y in zip(a, b)]
    monkeypatch.setattr(collate, "FIRST_BAND", first)
    monkeypatch.setattr(collate, "CELLS", cells)
    got = {k: w for some, ways in collate.align_pairs(a, b) for k, w in zip(some, ways, strict=True)}
    assert sorted(got) == list(range(len(a)))
    assert all(np.array_equal(got[k][side], want[k][side]) for k in got for side in (0, 1))
    if cells > 3000:  # near pairs never make a whole table
        monkeypatch.setattr(collate, "align_many", None)
        long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)) for _ in range(40)]
        near = [points(t[:50] + t[53:200] + "xyz" + t[201:]) for t in long] + [points(t.replace("e", "a")) for t in long]
        assert sum(len(some) for some, _ in collate.align_pairs([points(t) for t in long] * 2, near)) == 80


def test_columns_of_alignments_stay_in_their_task(spark):
    for name in ("align_agreement", "divergence_clusters"):
        shown = plan(registry.QUERIES[name](spark, SF))
        assert shown.count("Exchange") == 1 and "Window" not in shown and "Aggregate" not in shown


def test_compared_pairs_equal_their_columns(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        t = "".join(r.choice("abcde字12，黃 ") for _ in range(r.randint(0, 90)))
        rows.append((k, t, "".join(c for c in t if r.random() > 0.1) + r.choice(["", "12", "q"])))
    pairs = spark.createDataFrame([*rows, (90, None, "a"), (91, "", None), (92, "12", "")], "id long, a string, b string")
    columns, both = collate.alignments(pairs), collate.compared(pairs)
    names = ["id", "seg", "seg_a", "seg_b", "idx_a", "idx_b", "kind"]
    assert sorted(map(str, collate.clusters(both).select(names).collect())) == sorted(map(str, collate.divergences(columns).select(names).collect()))
    assert sorted(map(tuple, collate.agreed(both).collect())) == sorted(map(tuple, collate.agreement(columns, pairs).collect()))


def test_ranges_take_no_group_a_transcript(spark):
    shown = plan(registry.QUERIES["pagemap_ranges"](spark, SF))
    assert "FlatMapGroups" not in shown and "Window" not in shown


def test_anchors_of_many_pages_equal_those_of_each():
    r = random.Random(2)
    for n in (0, 5, 8, 9, 200, 3000):
        t = "".join(r.choice("abcd字") for _ in range(n))
        pages = [t[k : k + 150] for k in range(0, n, 150)] + ["", "abc", t[3:40][::-1], t[20:60]]
        grams = Counter(t[k : k + 8] for k in range(n - 7))
        want = []
        for p in pages:
            own = [t.index(g) for k in range(len(p) - 7) if grams[g := p[k : k + 8]] == 1]
            want.append((min(own, default=-1), len(own)))
        assert collate.anchors_of(pages, t) == want


def test_documents_that_share_their_keys_meet_entries_once(spark):
    """Nothing that a file name of all documents meets is a row for each of them."""
    from foliant.sources import bibtex

    n = 400
    docs = spark.range(n).select("id", F.concat(F.lit("title "), (F.col("id") % 5).cast("string")).alias("title"), F.lit("title.pdf").alias("filename"))
    entries = spark.createDataFrame([(k, f"title {k % 7}") for k in range(50)], "entry_id long, title string")
    got = bibtex.match_entries(docs, entries)
    assert {(r.status, r.hits, r.kind) for r in got.collect()} == {("ambiguous", 50, None)} and got.count() == n
    metrics = []

    def walk(node):
        name = node.nodeName()
        if "Join" in name or name == "Generate":
            m = node.metrics()
            if m.contains("numOutputRows"):
                metrics.append(m.apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        if hasattr(node, "plan") and name.startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            walk(node.plan())

    got.collect()
    done = got._jdf.queryExecution().executedPlan()
    walk(done.executedPlan() if done.nodeName() == "AdaptiveSparkPlan" else done)
    assert sum(m > n for m in metrics) == 0


@pytest.mark.parametrize("name", ["region_assign", "reading_order", "pages_reordered", "regions_recognised"])
def test_blocks_meet_the_regions_of_their_page_once(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got, want = same_rows(df, duck.sql(registry.SQL[name]))
    assert got == want
    assert plan(registry.QUERIES[name](spark, SF)).count("Join") <= {"pages_reordered": 2}.get(name, 1)


def test_mentions_are_found_once_a_session_and_move_as_numbers(spark):
    shown = plan(registry.QUERIES["mentions_invalidated"](spark, SF))
    assert "ArrowEvalPython" not in shown and "Window" not in shown
    shown = plan(registry.QUERIES["entity_details"](spark, SF))
    assert "ArrowEvalPython" not in shown and "_ok" not in shown.replace("anchor_ok", "")


def test_white_space_goes_from_a_text_once(spark):
    shown = registry.QUERIES["mentions_still_anchored"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _bare" in shown.split("Join", 1)[1]


def test_stretches_take_no_group_of_arrow_tables(spark):
    assert "CoGroup" not in plan(registry.QUERIES["mentions_compiled"](spark, SF))


def test_lines_and_surfaces_of_odd_kinds(spark):
    from foliant.operators import entities, reading

    m = spark.createDataFrame([(1, 1, 1, "ab"), (1, 1, 1, ""), (1, 1, 2, "ab"), (2, 1, 1, "ab"), (1, 1, 3, None)], "doc_id long, page_num int, block_num int, surface string")
    lines = spark.createDataFrame([(1, 1, 1, "x ab"), (1, 1, 1, None), (1, 1, 2, "a"), (1, 1, 2, "b"), (1, 1, 3, "c")], "doc_id long, page_num int, block_num int, text string")
    docs = spark.createDataFrame([(1, "t", "f")], "id long, title string, filename string")
    got = {(r.doc_id, r.block_num, r.surface): (r.anchor_ok, r.title) for r in reading.mentions_in_detail(m, docs, lines).collect()}
    assert got == {(1, 1, "ab"): (True, "t"), (1, 1, ""): (False, "t"), (1, 2, "ab"): (False, "t"), (2, 1, "ab"): (False, None), (1, 3, None): (False, "t")}
    names = spark.createDataFrame([(7, "a b"), (8, "ab"), (9, "x"), (7, "ab")], "entity_id long, surface string")
    blocks = spark.createDataFrame([(1, 1, 1, "zz a\nb"), (1, 1, 2, None), (2, 1, 1, "ba")], "doc_id long, page_num int, block_num int, index_text string")
    got = sorted(map(tuple, entities.places_of_names(names, blocks).collect()))
    assert got == [("a b", 1, 1, 1, 7), ("ab", 1, 1, 1, 7), ("ab", 1, 1, 1, 8)]
