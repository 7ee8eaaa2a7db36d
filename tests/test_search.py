"""Search against SQLite's full-text search, and its invariants on a Chinese corpus."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from foliant.functions.variants import ScriptVariants, confusion_forms, confusion_table, forms, read_confusions
from foliant.operators import search
from foliant.plans.search_plan import Planner, SearchPlan

CHARS = "學学據据考歷史論上谷郡戊戌戍abcÄ "


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    text = lambda n: "".join(r.choice(CHARS) for _ in range(n))
    return [(i % 7, i // 7, 1, text(r.randint(3, 60)), text(r.randint(3, 20)) if i % 3 else None) for i in range(210)]


@pytest.fixture(scope="module")
def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, page_num int, block_num int, index_text string, trans string").cache()


@pytest.fixture(scope="module")
def sqlite(rows):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(doc UNINDEXED, page UNINDEXED, text, trans, tokenize='trigram')")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", [(d, p, t, x) for d, p, _, t, x in rows])
    return con


@pytest.mark.parametrize("groups", [[["歷史論"]], [["上谷郡", "abc"]], [["aba"], ["學據考", "学据考", "bca"]], [["考據考"]], [["ÄBC", "cab"]]])
def test_rank_equals_sqlite(blocks, sqlite, groups):
    match = " AND ".join("(" + " OR ".join(f'"{v}"' for v in g) + ")" for g in groups)
    want = {(d, p): r for d, p, r in sqlite.execute("SELECT doc, page, rank FROM f WHERE f MATCH ?", (match,))}
    got = {(r.doc_id, r.page_num): r["rank"] for r in search.with_rank(blocks, SearchPlan(tuple(map(tuple, groups)))).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_short_words_fold_ascii_only(blocks, sqlite):
    for word in ("ab", "Ä", "學"):
        want = sqlite.execute("SELECT count(*) FROM f WHERE text LIKE ? OR trans LIKE ?", (f"%{word}%",) * 2).fetchone()[0]
        assert blocks.filter(search.matches(SearchPlan(short=((word,),)))).count() == want
    assert blocks.filter(search.matches(SearchPlan())).count() == 0


def test_old_and_new_script_find_the_same(blocks):
    p = Planner()
    for a, b in (("學據考", "学据考"), ("歷史", "历史")):
        assert sorted(blocks.filter(search.matches(p.plan(a))).collect()) == sorted(blocks.filter(search.matches(p.plan(b))).collect())


def test_confusions_only_add(blocks):
    plain, wide = Planner(confusions={}), Planner()
    assert blocks.filter(search.matches(wide.plan("戊戌"))).count() >= blocks.filter(search.matches(plain.plan("戊戌"))).count()


def test_tokens_and_forms():
    p = Planner()
    assert p.tokens('a"b') == ["ab"] and p.tokens("(") == [] and p.tokens("") == []
    assert p.tokens("Marc Bloch") == ["Marc Bloch"] and p.tokens("AI 歷史") == ["AI ", "歷史"]
    assert ScriptVariants().of("學a") == sorted(["學a", "学a"])
    assert confusion_forms(["戊戌"], confusion_table()) == ["戌戌", "戍戌", "戊戊", "戊戍"]
    assert len(forms("學據歷導論", ScriptVariants(), {})) == 32 and forms("學據歷導論臺", ScriptVariants(), {}) == ["學據歷導論臺"]
    assert p.highlight_terms("學堂")[0] in ("學堂", "学堂")


def test_filters_narrow(spark, blocks):
    docs = spark.createDataFrame([(i, ["primary"] if i % 2 else ["secondary"], f"{1900 + i}", f"{1900 + i}") for i in range(7)], "id int, source_tags array<string>, bib_date string, bib_year string")
    lines = blocks.select("doc_id", "page_num", "block_num", F.when(F.col("doc_id") > 2, "text").alias("block_label"))
    hits = search.with_rank(blocks, Planner().plan("abc"))
    all_ = search.filtered(hits, docs, lines).count()
    keep = search.filtered(hits, docs, lines, label=["text"]).count()
    drop = search.filtered(hits, docs, lines, exclude=["text"]).count()
    assert keep + drop == all_ >= keep
    assert search.filtered(hits, docs, lines, source_type="primary").count() + search.filtered(hits, docs, lines, source_type="secondary").count() == all_
    assert search.filtered(hits, docs, lines, source_type="other").count() == all_
    assert search.filtered(hits, docs, lines, year_from=1903, year_to=1903).select("doc_id").distinct().count() <= 1


def test_names_widen_a_query(spark, blocks):
    ents = spark.createDataFrame([(1, "上谷郡", ["歷史論", "ab"])], "id int, canonical string, aliases array<string>")
    names = spark.createDataFrame([(1, "上谷郡"), (1, "歷史論"), (1, "ab")], "entity_id int, name string")
    found = search.name_expansions(names, ents, Planner(), "上谷郡")
    assert found == ["歷史論", "ab"]
    wide = Planner().plan("上谷郡", found)
    assert wide.any_name and not wide.short
    assert blocks.filter(search.matches(wide)).count() >= blocks.filter(search.matches(Planner().plan("上谷郡"))).count()


def test_confusion_file(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# comment\n己\t已\tx\nab\tc\n", encoding="utf-8")
    assert sorted(map(tuple, read_confusions(spark, str(tmp_path / "c.tsv")).collect())) == [("己", "已"), ("已", "己")]
