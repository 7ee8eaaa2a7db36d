"""The written index against a search that reads all blocks, its bounds, its upkeep and its versions."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.variants import ScriptVariants
from foliant.operators import gram_index, search
from foliant.operators.gram_index import GramIndex
from foliant.plans.search_plan import Pattern, Planner, SearchPlan, pattern_grams

CHARS = "學学據据考歷史論上谷郡戊戌戍abcÄABİ \n"
SCHEMA = "doc_id long, page_num int, block_num int, index_text string, trans string, block_label string"


def text(r, n):
    return "".join(r.choice(CHARS) for _ in range(n))


def block_rows(seed, docs, base=0):
    r = random.Random(seed)
    return [(base + d, p, b, text(r, r.randint(0, 60)), text(r, r.randint(0, 15)) if r.random() < 0.5 else None, r.choice(["text", "header"])) for d in range(docs) for p in (1, 70) for b in (1, 2, 3)]


PLANS = {
    "phrase": SearchPlan((("歷史論",),)), "longer": SearchPlan((("abca",),)), "case": SearchPlan((("ÄBC", "cab"),)), "two": SearchPlan((("ab ", "上谷郡"), ("學據考", "bca", "a\nb"))),
    "short": SearchPlan(short=(("ab",),)), "one": SearchPlan(short=(("Ä", "戊"), ("C",))), "both": SearchPlan((("cab", "bab"),), (("學", "据"),)),
    "pattern": SearchPlan(any_name=(Pattern.of("[學学][據据]考", ["學学", "據据", "考"]),)), "names": SearchPlan(any_name=("歷史", "abc", "史論上")), "long": SearchPlan((("學據考歷史論上谷郡戊戌戍abcab",),)),
    "nothing": SearchPlan((("zzz",),)), "empty": SearchPlan(), "dotted": SearchPlan((("İab",),)),
}
PLANS["names"] = SearchPlan(any_name=("歷史論", "abc", "史論上"))


@pytest.fixture(scope="module")
def blocks(spark):
    rows = block_rows(1, 60) + [(900, 1, 1, "學據考歷史論上谷郡戊戌戍ABCab", None, "text"), (901, 1, 1, None, None, "text"), (902, 1, 1, "", "", None), (903, 1, 1, "abca " * 30_000, None, "text")]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def index(blocks, tmp_path_factory):
    gram_index.RUN = 16
    yield GramIndex.built(blocks, str(tmp_path_factory.mktemp("index")))
    gram_index.RUN = 1024


def rows(df, *columns):
    return sorted(map(str, (tuple(r) for r in df.select(*search.KEY, *columns).collect())))


@pytest.mark.parametrize("name", PLANS)
def test_index_finds_what_a_scan_finds(index, blocks, name):
    plan = PLANS[name]
    assert rows(index.hits(plan, ranked=False), "index_text", "trans") == rows(blocks.filter(search.matches(plan)), "index_text", "trans")
    ranked = F.round("rank", 9)
    assert rows(index.hits(plan), ranked) == rows(search.with_rank(blocks, plan), ranked)


@pytest.mark.parametrize(("name", "k"), [*((n, 3) for n in PLANS if PLANS[n].scored), ("two", 1000), ("longer", 1000)])
def test_best_are_the_first_of_all(index, blocks, name, k):
    plan = PLANS[name]
    some = lambda b: b.filter("block_label = 'text'")
    for keep in (lambda b: b, some)[: 1 + (k == 3)]:
        want = [tuple(r) for r in keep(search.with_rank(blocks, plan)).orderBy("rank", *search.KEY).limit(k).select(*search.KEY).collect()]
        got = index.best(plan, k, keep, first=2).orderBy("nth").collect()
        assert [tuple(r)[:3] for r in got] == want and [r.nth for r in got] == list(range(1, len(want) + 1))


def test_bounds_leave_most_runs_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gram_index, "RUN", 16)
    r = random.Random(2)
    b = spark.createDataFrame([(d, 1, 1, "the word here " * r.randint(1, 3) + "x" * r.randint(20, 900), None, "text") for d in range(1200)], SCHEMA)
    index = GramIndex.built(b, str(tmp_path))
    read = []
    for word in ("word", "ere", "here the", "xxx"):
        plan = SearchPlan(((word,),))
        want = [tuple(x) for x in search.with_rank(b, plan).orderBy("rank", *search.KEY).limit(5).select(*search.KEY).collect()]
        assert [tuple(x)[:3] for x in index.best(plan, 5, first=4).orderBy("nth").collect()] == want
        read.append(index.runs_read / index.runs_there)
    assert min(read) < 0.2 and sum(read) / len(read) < 0.7


def test_a_query_reads_its_grams_buckets(index):
    assert index.postings(["abc"]).select("gram").distinct().count() == 1
    plan = index.postings(["abc", "史論上"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters:")[1].split("]")[0]
    keys = index.hits(SearchPlan((("abc",),)), ranked=False).select(*search.KEY)._jdf.queryExecution().executedPlan().toString()
    assert "index_text" not in keys  # a phrase that is a gram needs no text


def postings_by_key(index):
    """What the index holds of blocks in force, by key of the block."""
    keys = index._live(index.written_blocks()).select("segment", "part", "no", *search.KEY)
    folders = {gram_index.grams_folder(s) for s in index.segments}
    grams = None
    for f in folders:
        own = index._table(f"{f}:all", gram_index.GRAMS_AS_WRITTEN, [f"{index.root}/{f}/segment={s['id']}" for s in index.segments if gram_index.grams_folder(s) == f])
        grams = own if grams is None else grams.unionAll(own)
    return rows(grams.select("gram", "segment", "part", F.explode("nos").alias("no")).join(keys, ["segment", "part", "no"]), "gram")


def same_index(spark, index, table, path):
    new = GramIndex.built(table, str(path))
    assert rows(index.blocks(), "index_text", "trans") == rows(table, "index_text", "trans")
    assert postings_by_key(index) == postings_by_key(new)
    assert index.totals() == new.totals()
    for plan in (PLANS["both"], PLANS["two"], PLANS["longer"]):
        assert rows(index.hits(plan), F.round("rank", 9)) == rows(new.hits(plan), F.round("rank", 9))
        assert index.best(plan, 5).collect() == new.best(plan, 5).collect()


def test_upkeep_equals_an_index_built_anew(spark, tmp_path):
    start = block_rows(3, 20)
    table = {r[:3]: r for r in start}
    make = lambda x: spark.createDataFrame(x, SCHEMA)
    first = index = GramIndex.built(make(start), str(tmp_path / "i"))
    r = random.Random(4)
    edits = [(*k, text(r, 40), None, "text") for k in r.sample(sorted(table), 5)]
    index = index.edited(make(edits))
    table |= {e[:3]: e for e in edits}
    more = block_rows(5, 4, base=100)
    index = index.changed(make(more))
    table |= {m[:3]: m for m in more}
    index = index.removed(spark.createDataFrame([(2,), (101,), (7777,)], "doc_id long"))
    table = {k: v for k, v in table.items() if k[0] not in (2, 101)}
    page = [(5, 70, 1, "a new page abc", None, "text")]
    index = index.changed(make(page), spark.createDataFrame([(5, 70)], "doc_id long, page_num int"))
    table = {k: v for k, v in table.items() if k[:2] != (5, 70)} | {page[0][:3]: page[0]}
    same_index(spark, index, make(list(table.values())), tmp_path / "n")
    # Versions that were published stay as they are, and the latest is found.
    assert rows(GramIndex.opened(spark, index.root, 1).blocks(), "index_text") == rows(make(start), "index_text") == rows(first.blocks(), "index_text")
    assert GramIndex.opened(spark, index.root).version == index.version == 5
    # One segment again: fewer files, the same rows, no marks.
    whole = index.compacted(least=10_000)
    assert len(whole.segments) == 1 and not whole.marks
    same_index(spark, whole, make(list(table.values())), tmp_path / "m")


def test_two_writers_and_compaction_of_small_segments(spark, tmp_path):
    make = lambda x: spark.createDataFrame(x, SCHEMA)
    index = GramIndex.built(make(block_rows(6, 30)), str(tmp_path / "i"))
    after = index.changed(make(block_rows(7, 2, base=500)))
    with pytest.raises(Exception, match="(?i)exists"):
        index.removed(spark.createDataFrame([(1,)], "doc_id long"))
    assert GramIndex.opened(spark, index.root).version == after.version == 2
    after = after.changed(make(block_rows(8, 2, base=600))).removed(spark.createDataFrame([(3,), (501,)], "doc_id long"))
    small = after.compacted(least=50)
    assert [s["blocks"] for s in small.segments] == [180, 18] and len(small.marks) == 1
    same_index(spark, small, after.blocks(), tmp_path / "n")


def test_old_format_is_filled_in(spark, tmp_path, monkeypatch):
    b = spark.createDataFrame(block_rows(9, 10), SCHEMA)
    monkeypatch.setattr(gram_index, "FORMAT", 1)
    old = GramIndex.built(b, str(tmp_path / "i"))
    monkeypatch.setattr(gram_index, "FORMAT", 2)
    mixed = old.changed(spark.createDataFrame(block_rows(10, 3, base=50), SCHEMA))
    assert {s["format"] for s in mixed.segments} == {1, 2}
    new = mixed.upgraded()
    assert {s["format"] for s in new.segments} == {2} and [s["id"] for s in new.segments] == [s["id"] for s in mixed.segments]
    for i in (mixed, new):
        same_index(spark, i, i.blocks(), tmp_path / f"n{i.version}")
    assert new.upgraded() is new


def test_empty_index(spark, tmp_path):
    index = GramIndex.built(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"))
    assert index.hits(PLANS["two"]).collect() == [] and index.best(PLANS["phrase"], 3).collect() == []
    assert index.removed(spark.createDataFrame([(1,)], "doc_id long")).blocks().collect() == []
    assert GramIndex.opened(spark, str(tmp_path / "i")).changed(spark.createDataFrame(block_rows(1, 2), SCHEMA)).blocks().count() == 12
    with pytest.raises(FileNotFoundError):
        GramIndex.opened(spark, str(tmp_path / "none"))


def test_grams_of_a_pattern():
    scripts = ScriptVariants(("學学", "據据"))
    p = Pattern.of(scripts.pattern("學據考A"), scripts.classes("學據考A"))
    assert pattern_grams(p) == [("学据考", "学據考", "學据考", "學據考"), ("据考a", "據考a")]
    assert pattern_grams("Abcd") == [("abc",), ("bcd",)]
    assert Planner(scripts=scripts).plan("學據考").phrases == (("学据考", "学據考", "學据考", "學據考"),)
