"""What a page of the proof-reading view shows, and what recognition and generation write into pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import folds
from foliant.functions.text import clamp_page, excerpt
from foliant.operators import layout
from foliant.operators.mutate import append_blocks, dense_blocks, replace_pages
from foliant.sources.adapters import blank_rows
from foliant.sources.scratch import written

KEY = ["doc_id", "page_num", "block_num"]


def document_mentions(mentions: DataFrame, entities: DataFrame, lines: DataFrame) -> DataFrame:
    """Valid mentions with name and category of their entity and the start of their block (120 characters)."""
    e = entities.select(F.col("id").alias("entity_id"), "canonical", "category")
    block = lines.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", F.coalesce("text", F.lit("")).alias("t")))), lambda r: r["t"]), "").alias("t"))
    m = mentions.filter("valid").join(e, "entity_id").join(block, KEY, "left")
    return m.withColumn("excerpt", F.coalesce(excerpt(F.col("t")), F.lit(""))).drop("t")


def page_model(docs: DataFrame, lines: DataFrame, mentions: DataFrame, entities: DataFrame, cards: DataFrame, page: int | None = None) -> DataFrame:
    """A row for each page (of every document, or the one that ``page`` is held to): its size, blocks with lines, mentions in order; cards and page count of its document."""
    pages = docs.select(F.col("id").alias("doc_id"), F.coalesce("page_count", F.lit(1)).alias("page_count"))
    n = F.explode(F.sequence(F.lit(1), F.greatest("page_count", F.lit(1)))) if page is None else clamp_page(F.lit(page), F.col("page_count"))
    pages = pages.withColumn("page_num", n)
    line = F.struct("line_num", F.col("id").alias("line_id"), "text")
    b = lines.groupBy(KEY).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.min_by("block_label", "id").alias("block_label"))
    p = b.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_num", "block_label", "lines"))).alias("blocks"))
    named = document_mentions(mentions, entities, lines)
    m = named.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_num", "canonical", "entity_id", "surface", "excerpt"))).alias("mentions"))
    c = cards.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "status", "content"))).alias("cards"))
    size = layout.page_size(lines) if {"bbox", "page_w", "page_h"} <= set(lines.columns) else lines.select("doc_id", "page_num", F.lit(None).cast("double").alias("page_w"), F.lit(None).cast("double").alias("page_h")).distinct()
    both = pages.join(p, ["doc_id", "page_num"], "left").join(m, ["doc_id", "page_num"], "left").join(size, ["doc_id", "page_num"], "left")
    return both.join(c, "doc_id", "left")


def document_cards(cards: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cards of each document, and its candidates by status, type and id."""
    c = cards.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "status", "content"))).alias("cards"))
    n = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("status", "ctype", "id", "label"))).alias("candidates"))
    return c.join(n, "doc_id", "full")


def vocabulary_of(terms: DataFrame, kind: str | None = None) -> DataFrame:
    return (terms if kind is None else terms.filter(F.col("kind") == kind)).select("kind", "term").distinct().orderBy("kind", "term")


def save_regions(have: DataFrame, new: DataFrame, most: int = 50) -> DataFrame:
    """Regions of pages replaced: boxes with four sides and an area, renumbered in order; a page with more than ``most`` keeps what it has."""
    b = layout.box("bbox")
    good = new.filter((F.size("bbox") == 4) & (b[2] > b[0]) & (b[3] > b[1]))
    full = good.groupBy("doc_id", "page_num").count().filter(F.col("count") <= most).select("doc_id", "page_num")
    good = good.join(full, ["doc_id", "page_num"], "left_semi")
    return replace_pages(have, good)


def reorder_page(lines: DataFrame, blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines with the block numbers that reading by regions gives; other pages stay."""
    order = layout.reading_order(blocks, regions).select(*KEY, "new_block")
    moved = lines.join(order, KEY, "left").withColumn("block_num", F.coalesce("new_block", "block_num").cast("int"))
    return moved.drop("new_block")


def recognised_regions(lines: DataFrame, blocks: DataFrame, regions: DataFrame, replace: bool = True) -> DataFrame:
    """Recognised blocks of pages that lie in a region, as the pages' lines: in the order of regions, numbered densely; in place of the pages or after them.

    ``blocks`` comes from an adapter over page images (``sources.ocr.lines``): doc_id, page_num,
    block_num, text, bbox.
    """
    inside = layout.with_regions(blocks, regions).filter(layout.first_region(0.5)["region_idx"].isNotNull())
    order = layout.in_order(inside).withColumn("block_num", F.col("new_block")).drop("new_block", "region_idx", "direction")
    new = dense_blocks(order.withColumn("line_num", F.lit(1)))
    new = written(new.select(*[c for c in lines.columns if c in new.columns]), "recognised")  # its pages are read before its rows
    return replace_pages(lines, new) if replace else append_blocks(lines, new)


def template_pages(regions: DataFrame, from_w: float, from_h: float, pages: DataFrame, first: int, last: int) -> DataFrame:
    """Regions of one page for a range of pages."""
    return layout.apply_template(regions, from_w, from_h, pages.filter(F.col("page_num").between(first, last)))


def autofill_requests(lines: DataFrame, targets: list[str], only_missing: bool = True) -> DataFrame:
    """Batches of lines to ask for: doc_id, page_num, batch, ids, request (JSON list of texts). At most four lines and 800 characters each."""
    todo = blank_rows(lines, targets) if only_missing else lines
    row = F.struct("block_num", "line_num", F.col("id").alias("line_id"), "text")
    p = todo.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    p = p.withColumn("b", folds.batches(F.transform("rows", lambda r: F.length(r["text"]))))
    x = p.select("doc_id", "page_num", F.explode(F.arrays_zip("rows", "b")).alias("x")).select("doc_id", "page_num", "x.b", "x.rows.*")
    g = x.groupBy("doc_id", "page_num", F.col("b").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("block_num", "line_num", "line_id", "text"))).alias("r"))
    return g.select("doc_id", "page_num", "batch", F.transform("r", lambda r: r["line_id"]).alias("ids"), F.to_json(F.transform("r", lambda r: r["text"])).alias("request"))


def apply_autofill(lines: DataFrame, answers: DataFrame, target: str, only_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ids, answer: JSON list of texts) -> lines with a draft in the target layer, and a revision row for each that changed.

    An answer that isn't a list of as many texts as were asked for changes nothing.
    """
    a = answers.select("ids", F.from_json(folds.json_array_in(F.col("answer")), "array<string>").alias("t")).filter("size(ids) = size(t)")
    new = a.select(F.explode(F.arrays_zip("ids", "t")).alias("x")).select(F.col("x.ids").alias("_id"), F.trim("x.t").alias("_new")).filter("_new <> ''")
    both = lines.join(new, F.col("id") == F.col("_id"), "left")
    free = F.coalesce(F.trim(target), F.lit("")) == ""
    set_ = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(target)) & (free if only_missing else F.lit(True))
    log = both.filter(set_).select(*KEY, F.coalesce(target, F.lit("")).alias("old_value"), F.col("_new").alias("new_value"))
    done = both.withColumns({"_set": set_, target: F.when(set_, F.col("_new")).otherwise(F.col(target))})
    draft = F.coalesce("draft", F.lit(False)) if "draft" in lines.columns else F.lit(False)
    return done.withColumn("draft", draft | F.coalesce("_set", F.lit(False))).drop("_id", "_new", "_set"), log


def repaired_lines(lines: DataFrame, page_texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with split words joined, where the text of their page (doc_id, page_num, text) knows the whole; and (id, old_value, new_value) of those that changed."""
    oracle = page_texts.select("doc_id", "page_num", folds.page_words(F.col("text")).alias("o"))
    both = lines.join(oracle, ["doc_id", "page_num"], "left")
    new = F.when(F.col("o").isNotNull(), folds.repair_split_words(F.col("text"), F.col("o.words"), F.col("o.pairs"), F.col("o.hyphenated"))).otherwise(F.col("text"))
    both = both.withColumn("_new", new)
    log = both.filter("_new <> text").select("id", F.col("text").alias("old_value"), F.col("_new").alias("new_value"))
    return both.withColumn("text", F.col("_new")).drop("o", "_new"), log


def wiki_samples(blocks: DataFrame, cards: DataFrame, docs: int = 10, per_doc: int = 3, labels: int = 15, most_cards: int = 20, chars: int = 80) -> DataFrame:
    """What goes into the request for a wiki: doc_id and part (block or card), in order, with its text; few and short by design.

    The first blocks of the first documents, and the first labels of reviewed cards.
    """
    first = blocks.select("doc_id").distinct().orderBy("doc_id").limit(docs)
    w = Window.partitionBy("doc_id").orderBy("page_num", "block_num")
    b = blocks.join(F.broadcast(first), "doc_id", "left_semi").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_doc)  # ``docs`` rows
    b = b.select("doc_id", F.lit("block").alias("part"), "n", F.substring("index_text", 1, chars).alias("text"))
    c = cards.filter("status = 'reviewed'").orderBy("doc_id", "kind").limit(most_cards).select("doc_id", F.lit("card").alias("part"), F.lit(0).alias("n"), F.array_join(F.slice("labels", 1, labels), ", ").alias("text"))
    return b.union(c)
