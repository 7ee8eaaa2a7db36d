"""Text files as documents, and documents as text: Markdown, native pages, transcripts, vocabularies, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import strip_markdown


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("filename"), F.col("value").alias("text"))


def markdown_lines(docs: DataFrame) -> DataFrame:
    """A file is one page and one block: a line for each line that isn't blank, its end trimmed."""
    rows = F.transform(F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return docs.select("doc_id", F.lit(1).alias("page_num"), F.lit(1).alias("block_num"), F.posexplode(rows).alias("line_num", "text")).withColumn("line_num", F.col("line_num") + 1)


def native_lines(pages: DataFrame) -> DataFrame:
    """Paragraphs of Markdown pages as blocks: marks gone, their lines joined, blank ones left out."""
    paras = F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(strip_markdown(p), r"\s*\n\s*", " ")))
    return pages.select("doc_id", "page_num", F.posexplode(F.filter(paras, lambda p: p != "")).alias("block_num", "text")).withColumn("block_num", F.col("block_num") + 1)


def sparse_pages(pages: DataFrame, most: float = 0.3) -> DataFrame:
    """Documents of which over 30 % of the pages have no text: they want recognition."""
    return pages.groupBy("doc_id").agg((F.count_if(F.trim("text") == "") / F.count("*")).alias("empty_share")).withColumn("warn", F.col("empty_share") > most)


def transcript_text(c: Column) -> Column:
    """Uploaded transcripts: heading marks and emphasis gone."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^#{1,6}\s*", ""), r"\*\*|__|\*", "")


def vocabulary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One term for each line, once."""
    return spark.read.text(path).select(F.lit(kind).alias("kind"), F.trim("value").alias("term")).filter("term <> ''").distinct()


def import_terms(have: DataFrame, new: DataFrame, kind: str, replace: bool = False) -> DataFrame:
    """Terms (kind, term) with those of ``new`` (a column of texts, a term a line) added to a kind, or in place of its own; none twice, blank ones not at all.

    Where ``new`` has no term the terms stay as they are, also with ``replace``.
    """
    come = new.select(F.explode(F.split(new.columns[0], r"\r\n|\n|\r")).alias("term")).select(F.lit(kind).alias("kind"), F.regexp_replace("term", r"(?U)^\s+|\s+$", "").alias("term")).filter("term <> ''")
    old = have.select("kind", "term")
    if replace and come.take(1):
        old = old.filter(~F.col("kind").eqNullSafe(F.lit(kind)))
    return old.union(come).distinct()


def front_matter(fields: dict[str, Column]) -> Column:
    """Header of an exported file: a JSON value for each field that isn't null."""
    rows = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n"))


def export_markdown(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """A text for each document: title and author, blocks apart by a blank line, lines by a newline."""
    block = lines.groupBy("doc_id", "page_num", "block_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "text"))), lambda r: r["text"]), "\n").alias("b"))
    body = block.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "block_num", "b"))), lambda r: r["b"]), "\n\n").alias("body"))
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("author", F.lit("")), F.lit("\n\n"))
    return docs.join(body, F.col("id") == F.col("doc_id")).select("doc_id", F.concat(head, "body").alias("markdown"))


def document_content(lines: DataFrame) -> DataFrame:
    """Each document as nested pages, blocks and lines, in order."""
    b = lines.groupBy("doc_id", "page_num", "block_num").agg(F.array_sort(F.collect_list(F.struct("line_num", "text"))).alias("lines"))
    p = b.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_num", "lines"))).alias("blocks"))
    return p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "blocks"))).alias("pages"))


def registry_json(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each entity with its valid mentions as one JSON text."""
    m = mentions.filter("valid").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "page_num", "block_num", "surface"))).alias("mentions"))
    e = entities.join(m, F.col("id") == F.col("entity_id"), "left")
    return e.select("id", F.to_json(F.struct("canonical", "category", "aliases", "ext_ids", "props", F.coalesce("mentions", F.array().cast("array<struct<doc_id:bigint,page_num:int,block_num:int,surface:string>>")).alias("mentions"))).alias("entity"))
