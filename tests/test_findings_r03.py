"""Faults that a review found on larger tables and odd titles."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.operators import entities, gram_index
from foliant.plans import reading_catalog, registry, text_catalog  # noqa: F401  the catalogues register their queries
from tests.conftest import SF, same_rows


@pytest.fixture
def shuffled(spark):
    """Joins of small tables are made as those of large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["page_edits", "pages_rewritten"])
def test_edits_that_are_a_union_of_rows(shuffled, duck, name):
    got, want = same_rows(registry.QUERIES[name](shuffled, SF), duck.sql(registry.SQL[name]))
    assert got == want


@pytest.mark.parametrize("name", ["cite_key_base", "cite_keys_by_sound"])
def test_titles_that_tell_a_volume(spark, tmp_path, name):
    docs = "SELECT * FROM (VALUES (1::BIGINT, 'report (17) of a year', 'en', 'src1'), (2, 'plain words', 'en', 'src2'), (3, NULL, 'de', 'src3')) t(doc_id, text, lang, source)"
    con = duckdb.connect()
    con.sql(f"COPY ({docs}) TO '{tmp_path}/documents.parquet'")
    con.sql(f"CREATE VIEW documents AS {docs}")
    got, want = same_rows(registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.SQL[name]))
    assert got == want


def test_neighbours_of_crowded_pages_are_not_shuffled_as_pairs(spark):
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    n = 1200
    m = spark.range(n).select((F.col("id") * 7).alias("entity_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page_num"), F.lit(1).alias("doc_id"), F.lit(True).alias("valid"))
    m = m.filter("page_num < 5 OR entity_id < 700")
    before = sent()
    got = {(r.entity_id, r.other): r.pages for r in entities.neighbours(m, top=3).collect()}
    assert sent() - before < 1_000_000  # pairs: 1.4 million rows
    first = lambda e, own: [o for o in range(0, 7 * own, 7) if o != e][:3]
    assert got == {(e, o): 5 if e < 700 else 4 for e in range(0, 7 * n, 7) for o in first(e, n)}
    one = entities.neighbours(m, 14, top=3).collect()
    assert sorted((r.entity_id, r.other, r.pages) for r in one) == [(14, o, 5) for o in (0, 7, 21)]


def test_postings_are_made_once_and_blocks_keep_their_order(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    postings = gram_index._postings

    def counted(table):
        made.add(1)
        return postings(table)

    monkeypatch.setattr(gram_index, "_postings", counted)
    monkeypatch.setattr(gram_index, "RUN", 16)
    rows = [(d, p, b, f"text {d} of page {p} and block {b}", "text") for d in range(40) for p in (1, 2) for b in (3, 1, 2)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_num int, block_num int, index_text string, block_label string")
    written = gram_index.GramIndex.built(blocks, f"{tmp_path}/index").written_blocks()
    found = written.orderBy("part", "no").collect()
    assert made.value == written.select("part", "run").distinct().count()
    for part in {r.part for r in found}:
        own = [r for r in found if r.part == part]
        assert [r.no for r in own] == list(range(len(own))) and [r.run for r in own] == [r.no // 16 for r in own]
        assert [(r.doc_id, r.page_num, r.block_num) for r in own] == sorted((r.doc_id, r.page_num, r.block_num) for r in own)
