"""Terms that a document itself names as its subjects: an entity card, else its keywords and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import split_terms
from foliant.operators.entities import distinct_seeds

#: The kind of card that lists a document's entities; fields and headings of keywords; headings of an index.
CARD = "entity_source"
KEYWORD_FIELDS = ("keywords", "keyword", "关键词", "关键字")
KEYWORD_HEADING = r"(?i)(?:^|\n)\s*(?:关键词|关键字|關鍵詞|key\s*words?)\s*[:：]?\s*([^\n]+)"
INDEX_HEADING = r"(?i)^\s*(?:索引|index)\s*$"
#: Signs between and after the page numbers of an index entry; dots that lead from a term to its numbers.
BETWEEN_NUMBERS, LEADERS = ",，、-–—", ".·…"
_SEED = ["doc_id", "surface", "page_num", "block_num", "source", "turn", "pos"]


def card_seeds(cards: DataFrame) -> DataFrame:
    """Terms of entity cards: keywords, then index entries ({term, page_num} or plain texts); blank ones and bad JSON give none."""
    c = cards.filter(F.col("kind") == CARD).select("doc_id", F.from_json("content", "struct<keywords:array<string>,index:array<string>>").alias("c"))
    keyword = c.select("doc_id", F.posexplode("c.keywords").alias("pos", "raw")).select("doc_id", F.trim("raw").alias("surface"), F.lit(None).cast("int").alias("page_num"), F.lit("card:keywords").alias("source"), F.lit(0).alias("turn"), "pos")
    entry = F.from_json("raw", "struct<term:string,page_num:string>")
    term = F.when(F.ltrim("raw").startswith("{"), entry["term"]).otherwise(F.col("raw"))
    index = c.select("doc_id", F.posexplode("c.index").alias("pos", "raw")).select("doc_id", F.trim(term).alias("surface"), F.when(F.ltrim("raw").startswith("{"), entry["page_num"].try_cast("int")).alias("page_num"), F.lit("card:index").alias("source"), F.lit(1).alias("turn"), "pos")
    return keyword.unionByName(index).filter("surface <> ''").withColumn("block_num", F.lit(None).cast("int")).select(_SEED)


def field_seeds(docs: DataFrame) -> DataFrame:
    """Terms of the keyword fields of a document's bibliographic data."""
    values = F.array(*[F.try_element_at("bib_data", F.lit(k)) for k in KEYWORD_FIELDS])
    t = docs.select(F.col("id").alias("doc_id"), F.posexplode(F.flatten(F.transform(values, split_terms))).alias("pos", "surface"))
    none = F.lit(None).cast("int")
    return t.select("doc_id", "surface", none.alias("page_num"), none.alias("block_num"), F.lit("bib:keywords").alias("source"), F.lit(0).alias("turn"), "pos")


def paragraph_seeds(blocks: DataFrame) -> DataFrame:
    """Terms of the first paragraph of each document that begins with a heading of keywords."""
    b = blocks.select("doc_id", "page_num", "block_num", F.regexp_extract("index_text", KEYWORD_HEADING, 1).alias("rest")).filter("rest <> ''")
    first = b.groupBy("doc_id").agg(F.min(F.struct("page_num", "block_num", "rest")).alias("f"))
    t = first.select("doc_id", "f.page_num", "f.block_num", F.posexplode(split_terms(F.col("f.rest"))).alias("pos", "surface"))
    return t.select("doc_id", "surface", "page_num", "block_num", F.lit("text:keywords").alias("source"), F.lit(1).alias("turn"), "pos")


def index_seeds(blocks: DataFrame) -> DataFrame:
    """Terms (2 to 24 characters) of the lines after a block that is the heading of an index."""
    heading = blocks.filter(F.trim("index_text").rlike(INDEX_HEADING)).groupBy("doc_id").agg(F.min(F.struct("page_num", "block_num")).alias("_from"))
    after = blocks.join(heading, "doc_id").filter(F.struct("page_num", "block_num") > F.col("_from"))
    line = after.select("doc_id", "page_num", "block_num", F.posexplode(F.split("index_text", "\n")).alias("l", "raw")).withColumn("raw", F.trim("raw"))
    signs = "".join(f"\\{c}" for c in BETWEEN_NUMBERS)
    line = line.filter(~F.col("raw").rlike(rf"^[\d\s{signs}{LEADERS}]*$"))  # what is left has more than numbers
    gap = rf"[{LEADERS}]{{2}}|\s{{2}}"
    head = F.btrim(F.regexp_extract("raw", rf"^(?:(?!{gap}).)*", 0), F.lit(f" {LEADERS}"))  # up to where the dots or a gap lead on
    term = F.trim(F.regexp_extract(head, rf"^[^\d{signs}]*", 0))  # up to its first number
    t = line.withColumn("surface", term).filter(F.length("surface").between(2, 24))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "block_num", "l"))
    return t.select("doc_id", "surface", "page_num", "block_num", F.lit("text:index").alias("source"), F.lit(2).alias("turn"), pos.alias("pos"))


def authoritative_seeds(docs: DataFrame, blocks: DataFrame, cards: DataFrame) -> DataFrame:
    """Seeds of each document, in order, each surface once: those of its card; without a card (or with an empty one) keyword fields, then for papers the keyword paragraph and for books the index.

    ``docs`` has id, doc_kind and bib_data.
    """
    card = card_seeds(cards)
    plain = docs.join(card.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")
    of = lambda kind: blocks.join(plain.filter(F.col("doc_kind") == kind).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    found = card.unionByName(field_seeds(plain)).unionByName(paragraph_seeds(of("paper"))).unionByName(index_seeds(of("book")))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "pos"))
    return distinct_seeds(found.withColumn("pos", order).drop("turn"))
