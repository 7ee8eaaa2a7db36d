"""The corpus model over the driver's tables: documents, lines and blocks.

A block is two lines that aren't blank, a page three blocks; the first block of a
page is its header and short blocks are footers. Titles, years and
source tags follow from ids, as the tables have none.

Lines, blocks and the gram index are taken in once a session and version of the texts, as
written tables that many tasks can read at once: queries read those, not the texts. A
version is known by the names, lengths and times of its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.gram_index import GramIndex
from foliant.plans.search_plan import Planner
from foliant.sources.scratch import folder, stamps, written

PER_BLOCK, PER_PAGE = 2, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    tag = F.element_at(F.array(F.lit("primary"), F.lit("secondary"), F.lit("reference")), (F.col("doc_id") % 3 + 1).cast("int"))
    year = (1900 + F.col("doc_id") % 120).cast("string")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit("-"), F.col("doc_id")).alias("cite_key"), F.substring("text", 1, 24).alias("title"),
        F.col("source").alias("author"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md")).alias("filename"), F.array(tag).alias("source_tags"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(year, F.lit("-01"))).alias("bib_date"), year.alias("bib_year"), "lang", F.col("source").alias("collection"),
        F.when(F.col("doc_id") % 4 == 0, "ocr").when(F.col("doc_id") % 4 == 1, "born-digital").otherwise("markdown").alias("doc_type"),
        F.greatest(F.lit(1), F.ceil(F.length("text") / 1000)).cast("int").alias("page_count"),
    )


_TAKEN_IN: dict[tuple, DataFrame | GramIndex] = {}


def forget() -> None:
    _TAKEN_IN.clear()


def taken_in(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame], DataFrame | GramIndex]) -> DataFrame | GramIndex:
    """What is made of the texts once a session and version of them."""
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, name, *stamps(docs))
    if key not in _TAKEN_IN:
        _TAKEN_IN[key] = build(docs)
    return _TAKEN_IN[key]


def _spread(rows: DataFrame, name: str) -> DataFrame:
    """The written table; few large files are read by few tasks, so it has a file for each core."""
    parts = rows.sparkSession.sparkContext.defaultParallelism
    return written(rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows, name, packed=True)


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, page_num, block_num, block_label, block (array of lines): numbers come from array positions, so nothing is shuffled."""
    rows = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    d = docs.select(F.col(id_col).alias("doc_id"), rows.alias("rows"))
    starts = F.when(F.size("rows") > 0, F.sequence(F.lit(0), F.size("rows") - 1, F.lit(PER_BLOCK)))
    b = d.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.slice("rows", i + 1, PER_BLOCK))).alias("b", "block"))
    label = F.when(F.col("b") % PER_PAGE == 0, "header").when(F.length(F.array_join("block", "\n")) < 60, "footer").otherwise("text")
    return b.select("doc_id", (F.floor(F.col("b") / PER_PAGE) + 1).cast("int").alias("page_num"), (F.col("b") % PER_PAGE + 1).cast("int").alias("block_num"), label.alias("block_label"), "block")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    b = _split(docs, id_col, text_col).select("doc_id", "page_num", "block_num", "block_label", F.posexplode("block").alias("l", "text"))
    key = F.col("doc_id") * 1_000_000_000 + F.col("page_num") * 1_000_000 + F.col("block_num") * 10_000 + F.col("l")
    return b.select(key.alias("id"), "doc_id", "page_num", "block_num", (F.col("l") + 1).cast("int").alias("line_num"), "text", "block_label")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_in(spark, sf_dir, "lines", lambda docs: _spread(lines_of(docs, "doc_id", "text"), "lines"))


def blocks_of(lines: DataFrame, planner: Planner | None = None) -> DataFrame:
    """Blocks as they are indexed: lines joined by newlines (words cut as the planner cuts those of a query), translations by spaces."""
    row = F.struct("line_num", "text", *(["trans"] if "trans" in lines.columns else []))
    g = lines.groupBy("doc_id", "page_num", "block_num").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("block_label").alias("block_label"), F.array_distinct(F.transform(F.collect_list(F.struct("block_label")), lambda s: s["block_label"])).alias("labels"))
    trans = F.array_join(F.filter(F.transform("rows", lambda r: r["trans"]), lambda t: F.trim(t) != ""), " ") if "trans" in lines.columns else F.lit(None).cast("string")
    text = (planner or Planner()).index_text(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"))
    return g.select("doc_id", "page_num", "block_num", text.alias("index_text"), trans.alias("trans"), "block_label", "labels")


def _blocks(docs: DataFrame) -> DataFrame:
    b = _split(docs, "doc_id", "text")
    return b.select("doc_id", "page_num", "block_num", F.array_join("block", "\n").alias("index_text"), F.lit(None).cast("string").alias("trans"), "block_label", F.array("block_label").alias("labels"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks straight from the texts: the same rows as ``blocks_of(lines(...))``, without its shuffle."""
    return taken_in(spark, sf_dir, "blocks", lambda docs: _spread(_blocks(docs), "blocks"))


def for_one_pass(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lines or blocks for a query that reads them once: straight from the texts, unless they are taken in already or the texts have too few parts for all cores."""
    docs = table(spark, sf_dir, "documents")
    rows = {"lines": lambda: lines_of(docs, "doc_id", "text"), "blocks": lambda: _blocks(docs)}[name]()
    there = (spark.sparkContext.applicationId, name, *stamps(docs)) in _TAKEN_IN
    few = rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    return {"lines": lines, "blocks": blocks}[name](spark, sf_dir) if there or few else rows


def index(spark: SparkSession, sf_dir: str) -> GramIndex:
    """The gram index of all blocks."""
    return taken_in(spark, sf_dir, "index", lambda docs: GramIndex.built(blocks(spark, sf_dir), f"{folder(spark)}/index-{uuid.uuid4().hex}"))


#: The same model for DuckDB.
SQL_MODEL = f"""
docs AS (SELECT doc_id AS id, source || '-' || doc_id AS cite_key, substr(text, 1, 24) AS title, source AS author, 'doc_' || doc_id || '.md' AS filename,
  CASE doc_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'reference' END AS tag,
  CASE WHEN doc_id % 7 <> 0 THEN (1900 + doc_id % 120) || '-01' END AS bib_date, (1900 + doc_id % 120)::VARCHAR AS bib_year, lang, source AS collection,
  CASE doc_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'born-digital' ELSE 'markdown' END AS doc_type,
  greatest(1, ceil(length(text) / 1000.0))::INT AS page_count FROM documents),
bs AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
bx AS (SELECT doc_id, l, unnest(range((len(l) + {PER_BLOCK - 1}) // {PER_BLOCK})) AS b FROM bs),
by_ AS (SELECT doc_id, (b // {PER_PAGE} + 1)::INT AS page_num, (b % {PER_PAGE} + 1)::INT AS block_num, rows,
  CASE WHEN b % {PER_PAGE} = 0 THEN 'header' WHEN length(array_to_string(rows, chr(10))) < 60 THEN 'footer' ELSE 'text' END AS block_label
  FROM (SELECT *, l[b * {PER_BLOCK} + 1 : b * {PER_BLOCK} + {PER_BLOCK}] AS rows FROM bx)),
lines AS (SELECT doc_id * 1000000000 + page_num * 1000000 + block_num * 10000 + i AS id, doc_id, page_num, block_num, (i + 1)::INT AS line_num, text, block_label
  FROM (SELECT *, unnest(rows) AS text, unnest(range(len(rows))) AS i FROM by_)),
blocks AS (SELECT doc_id, page_num, block_num, array_to_string(rows, chr(10)) AS index_text, block_label FROM by_ WHERE len(rows) > 0)
"""
