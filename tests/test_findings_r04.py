"""Faults that a review found on tables of 1 GB and 6 GB."""

import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import entities, mutate, reading


def sent(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_lists_of_pages_are_not_sent_to_cells(spark, monkeypatch):
    monkeypatch.setattr(entities, "MOST_COUNTS", 1 << 16)
    r, pages = random.Random(6), defaultdict(Counter)
    on = {(d, p): r.sample(range(0, 6000, 2), r.choice([1, 2, 90])) for d in range(60) for p in range(10)}
    for here in on.values():
        for e in here:
            pages[e].update(o for o in here if o != e)
    rows = [(e, d, p, True) for (d, p), here in on.items() for e in here]
    m = spark.createDataFrame([*rows, *rows[:50], (1, 1, 1, False)], "entity_id long, doc_id long, page_num int, valid boolean")
    before = sent(spark)
    got = sorted((x.entity_id, x.other, x.pages) for x in entities.neighbours(m, top=4).collect())
    assert sent(spark) - before < 1_000_000
    assert got == sorted((e, o, n) for e, c in pages.items() for o, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:4])
    assert entities.neighbours(m.filter("NOT valid")).collect() == []


def test_pairs_are_added_a_stretch_at_a_time(monkeypatch):
    monkeypatch.setattr(entities, "MOST_PAIRS", 3)
    counts = np.zeros((2, 6), np.int32)
    entities._added(counts, np.array([0, 0, 1]), np.array([0, 2, 2]), np.array([2, 4, 4]), np.array([5, 1, 0, 1, 2, 3]))
    assert counts.tolist() == [[1, 2, 1, 1, 0, 1], [1, 1, 1, 1, 0, 0]]


@pytest.fixture
def shuffled(spark):
    """Joins of small tables are made as those of large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LINE = "id long, doc_id long, page_num int, block_num int, line_num int, text string, block_label string"


@pytest.mark.parametrize("which", [1, 0], ids=["page_edits", "pages_rewritten"])
def test_texts_of_edited_pages_move_once(shuffled, tmp_path, which):
    r, letters = random.Random(8), string.ascii_letters + string.digits
    text = lambda: "".join(r.choices(letters, k=1000))
    rows = [(d * 100 + p * 10 + b, d, p, b, 1, text(), "text") for d in range(50) for p in range(1, 9) for b in range(1, 5)]
    shuffled.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lines")
    lines = shuffled.read.parquet(f"{tmp_path}/lines")
    new = lines.select("doc_id", "page_num", F.col("block_num").alias("pos"), F.reverse("text").alias("text"))
    before = sent(shuffled)
    mutate.edit_pages(lines, new)[which].write.format("noop").mode("overwrite").save()
    assert sent(shuffled) - before < 2.5 * 1000 * len(rows)


@pytest.mark.parametrize("edited", [[(1, 1)], [(1, 1), (1, 2), (2, 1)]], ids=["few", "most"])
def test_pages_that_are_not_edited_stay(spark, edited):
    rows = [(n, d, p, b, 1, f"{d}.{p}.{b}", "text") for n, (d, p, b) in enumerate([(1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (None, 1, 1), (3, None, 1)], 1)]
    new = [(d, p, q, t) for d, p in edited for q, t in [(2, "b"), (None, "no place"), (1, f"{d}.{p}.1"), (-1, "before"), (9, "far")]]
    after, log = mutate.edit_pages(spark.createDataFrame(rows, LINE), spark.createDataFrame(new, "doc_id long, page_num int, pos int, text string"))
    stay = [r for r in rows if r[1:3] not in edited]
    got = sorted(map(tuple, after.select("id", "doc_id", "page_num", "text").collect()), key=str)
    fresh = [(9 + 5 * k + i, *at, t) for k, at in enumerate(edited) for i, t in enumerate(["no place", "before", f"{at[0]}.{at[1]}.1", "b", "far"])]
    assert got == sorted([*((r[0], r[1], r[2], r[5]) for r in stay), *fresh], key=str)
    want = [(*at, *x) for at in edited for x in [(None, "", "no place"), (-1, "", "before"), (9, "", "far"), (2, "1.1.2" if at == (1, 1) else "", "b")]]
    assert sorted(map(tuple, log.collect()), key=str) == sorted(want, key=str)


def test_counts_of_mentions_take_no_list(shuffled):
    e = shuffled.range(20).selectExpr("id", "concat('name ', id) AS canonical", "array() AS aliases")
    lines = shuffled.range(2000).selectExpr("id AS doc_id", "1 AS page_num", "1 AS block_num", "concat('a name ', id % 20) AS text")
    m = shuffled.range(20000).selectExpr("id % 20 AS entity_id", "id DIV 10 AS doc_id", "1 AS page_num", "1 AS block_num", "concat('name ', id % 20) AS surface", "true AS valid")
    docs = shuffled.range(2000).select("id", F.concat_ws("", *[F.sha2(F.concat("id", F.lit(f"/{k}")), 512) for k in range(8)]).alias("title"), F.lit("f").alias("filename"))
    x = reading.entities_in_detail(e, entities.entity_names(e), m, docs, lines, limit=None)
    before = sent(shuffled)
    got = {r.id: (r.mention_count, r.listed, r.anchored) for r in x.select("id", "mention_count", "listed", "anchored").collect()}
    assert sent(shuffled) - before < 600_000  # a title is 1024 characters
    stand = Counter(i % 20 for i in range(20000) if f"name {i % 20}" in f"a name {i // 10 % 20}")
    assert got == {k: (1000, 1000, stand[k]) for k in range(20)} and sum(stand.values()) > 1000
    whole = {r.id: (len(r.mentions), sum(y.anchor_ok for y in r.mentions)) for r in x.collect()}
    assert whole == {k: (1000, stand[k]) for k in range(20)}


def test_places_beyond_the_first_are_dropped_before_they_are_sent(spark):
    names = spark.createDataFrame([("name",), ("rare",)], "surface string")
    rows = [(d, p, b, "a name" if d else "b rare name") for d in range(4) for p in range(1, 401) for b in (1, 2)]
    rows += [(9, p, 1, "name") for p in range(400, 0, -1)] + [(None, 1, 1, "rare"), (8, None, 1, "rare"), (8, 1, None, "rare"), (8, 2, 1, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_num int, block_num int, index_text string").coalesce(1)
    got = entities.places_of_names(names, blocks, 3)
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange") == 1 and "hashpartitioning(doc_id" in shown and "MapInArrow" in shown
    found = sorted(map(tuple, got.collect()), key=str)
    first = [("name", d, *at) for d in range(4) for at in ((1, 1), (1, 2), (2, 1))] + [("rare", 0, *at) for at in ((1, 1), (1, 2), (2, 1))]
    assert found == sorted([*first, *[("name", 9, p, 1) for p in (1, 2, 3)], ("rare", None, 1, 1), ("rare", 8, None, 1), ("rare", 8, 1, None)], key=str)
