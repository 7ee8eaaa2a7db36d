"""What a reader's views are made of: entities in detail, the text of a selection, the context of a question, a look at the state of a shelf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.entities import mention_counts
from foliant.operators.layout import selected
from foliant.operators.search import variant_predicate
from foliant.operators.side_hits import filtered_entities, page_notes
from foliant.operators.stats import chat_tail
from foliant.plans.search_plan import Planner

PAGE = ["doc_id", "page_num"]
BLOCK = [*PAGE, "block_num"]


def _anchored(mentions: DataFrame, lines: DataFrame) -> DataFrame:
    """Mentions with ``anchor_ok``: whether the surface still stands in a line of their block."""
    # Lines and mentions each move once to their block; nothing of a line is kept but the answer.
    texts = lines.groupBy(BLOCK).agg(F.collect_list("text").alias("_texts"))
    stands = F.exists("_texts", lambda t: F.contains(t, F.col("surface"))) & (F.col("surface") != "")
    return mentions.join(texts, BLOCK, "left").withColumn("anchor_ok", F.coalesce(stands, F.lit(False))).drop("_texts")


def mentions_in_detail(mentions: DataFrame, docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Mentions with title and file name of their document, and whether the surface still stands in a line of their block."""
    d = docs.select(F.col("id").alias("doc_id"), "title", "filename")
    return _anchored(mentions, lines).join(d, "doc_id", "left")


def entities_in_detail(
    entities: DataFrame, names: DataFrame, mentions: DataFrame, docs: DataFrame, lines: DataFrame, planner: Planner | None = None, query: str | None = None,
    category: str | None = None, doc_id: int | None = None, limit: int | None = 500, **constraints,
) -> DataFrame:
    """Entities by a word of their names, category and constraints (era, scope, year), in order of name, with the number of valid mentions and the mentions (of one document, where it is given) in order.

    ``listed`` and ``anchored`` are how many mentions are in the list and still stand; who takes these alone doesn't make the list.
    """
    e = entities if category is None else entities.filter(F.col("category") == category)
    if query:
        ids = names.filter(variant_predicate(planner or Planner(), query, ["name"])).select(F.col("entity_id").alias("id")).distinct()
        e = e.join(ids, "id", "left_semi")
    if constraints:
        e = filtered_entities(e, **constraints)
    e = e if limit is None else e.orderBy("canonical", "id").limit(limit)
    own = mentions if doc_id is None else mentions.filter(F.col("doc_id") == doc_id)
    own = own.join(e.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    n = _anchored(own, lines).groupBy("entity_id").agg(F.count("*").cast("int").alias("listed"), F.count_if("anchor_ok").cast("int").alias("anchored"))
    own = mentions_in_detail(own, docs, lines)
    row = F.struct(*BLOCK, "surface", "valid", "anchor_ok", "title", "filename")
    listed = own.groupBy("entity_id").agg(F.array_sort(F.collect_list(row)).alias("mentions"))
    counts = mention_counts(e, mentions).select("entity_id", F.col("mentions").alias("mention_count"))
    none = F.array().cast(listed.schema["mentions"].dataType)
    out = e.join(counts, F.col("id") == F.col("entity_id")).drop("entity_id").join(listed, F.col("id") == F.col("entity_id"), "left").drop("entity_id")
    out = out.join(n, F.col("id") == F.col("entity_id"), "left").drop("entity_id").fillna(0, ["listed", "anchored"])
    return out.withColumn("mentions", F.coalesce("mentions", none))


def region_texts(lines: DataFrame, x: float, y: float, w: float, h: float, most_chars: int = 4000) -> DataFrame:
    """doc_id, page_num, text: the lines that a selection (0..1) covers, whole, in order, held to ``most_chars`` characters."""
    text = F.trim("text")
    hit = selected(lines, x, y, w, h).withColumn("_t", text).filter("_t <> ''")
    g = hit.groupBy(PAGE).agg(F.array_sort(F.collect_list(F.struct("block_num", "line_num", F.col("_t").alias("t")))).alias("r"))
    return g.select(*PAGE, F.substring(F.array_join(F.transform("r", lambda r: r["t"]), "\n"), 1, most_chars).alias("text"))


def questions(asked: DataFrame, chat: DataFrame, notes: DataFrame, regions: DataFrame, system: str, turns: int = 12, most_chars: int = 8000, most_notes: int = 20) -> DataFrame:
    """The messages to send for each question (conv_id, doc_id, page_num, question): the system's, the tail of the talk, and the question after its context.

    Context are the text of the selection (``regions``: conv_id, text) and the first notes of the page,
    each under its heading; a question that is blank is left out.
    """
    q = asked.withColumn("question", F.trim("question")).filter("question <> ''")
    n = notes.filter("coalesce(note, '') <> '' OR coalesce(clip_text, '') <> ''")
    first = n.join(q.select(*PAGE).distinct(), PAGE, "left_semi").groupBy(PAGE).agg(F.slice(F.array_sort(F.collect_list(F.struct("id", "note", "clip_text"))), 1, most_notes).alias("n"))
    first = first.select(*PAGE, F.explode("n").alias("n")).select(*PAGE, "n.*")
    q = q.join(page_notes(first), PAGE, "left").join(regions.select("conv_id", F.col("text").alias("clip")), "conv_id", "left")
    # The headings of the parts.
    clip = F.when(F.col("clip") != "", F.concat(F.lit("【选区文本 第"), F.coalesce(F.col("page_num").cast("string"), F.lit("None")), F.lit("页】\n"), "clip"))
    noted = F.when(F.col("notes") != "", F.concat(F.lit("【用户在本页的批注】\n"), "notes"))
    context = F.array_join(F.array_compact(F.array(clip, noted)), "\n\n")
    content = F.when(context != "", F.concat(context, F.lit("\n\n【提问】"), "question")).otherwise(F.col("question"))
    tail = chat_tail(chat, turns, most_chars).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    message = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    talk = F.transform(F.coalesce("r", F.array().cast("array<struct<turn:int,role:string,text:string>>")), lambda r: message(r["role"], r["text"]))
    all_ = F.concat(F.array(message(F.lit("system"), F.lit(system))), talk, F.array(message(F.lit("user"), content)))
    return q.join(tail, "conv_id", "left").select("conv_id", "doc_id", "page_num", all_.alias("messages"))


def _count(name: str, rows: DataFrame, of: Column | None = None) -> DataFrame:
    return rows.agg((F.count("*") if of is None else of).alias("n")).select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))


def examined(docs: DataFrame, lines: DataFrame, blocks: DataFrame, mentions: DataFrame, listing: DataFrame) -> DataFrame:
    """check, n: how many rows a shelf has, and how many of them something is wrong with."""
    ids = docs.select(F.col("id").alias("doc_id"))
    places = lines.select(*BLOCK).distinct()
    checks = [
        _count("documents", docs), _count("lines", lines), _count("blocks", blocks), _count("mentions", mentions),
        _count("documents without a line", docs.join(lines.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")),
        _count("lines of no document", lines.join(ids, "doc_id", "left_anti")),
        _count("blocks of no line", blocks.join(places, BLOCK, "left_anti")), _count("lines of no block", places.join(blocks, BLOCK, "left_anti")),
        _count("mentions of no document", mentions.join(ids, "doc_id", "left_anti")),
        _count("cite keys of several documents", docs.filter("cite_key <> ''").groupBy("collection", "cite_key").count().filter("count > 1")),
        _count("documents without a file", docs.join(listing.select("collection", F.col("name").alias("filename")), ["collection", "filename"], "left_anti")),
        _count("files of no document", listing.join(docs.select("collection", F.col("filename").alias("name")), ["collection", "name"], "left_anti")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out
