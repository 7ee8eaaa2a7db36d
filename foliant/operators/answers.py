"""What a reader's search answers with: hits, side groups, totals, and the event to log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import highlight
from foliant.operators import search, side_hits
from foliant.operators.gram_index import GramIndex
from foliant.plans.search_plan import Planner


class Shelf(NamedTuple):
    """Tables of a collection that a search looks at; of its blocks, the index or the whole table."""

    blocks: DataFrame | GramIndex
    docs: DataFrame
    lines: DataFrame
    cards: DataFrame
    wiki: DataFrame
    entities: DataFrame
    names: DataFrame
    mentions: DataFrame
    notes: DataFrame


def _found(shelf: Shelf, planner: Planner, query: str, filters: dict, names: list[str] | None = None) -> DataFrame:
    return search.search(shelf.blocks, shelf.docs, shelf.lines, query, planner, names, **filters)


def page_of_hits(shelf: Shelf, query: str, planner: Planner | None = None, limit: int = 20, offset: int = 0, **filters) -> dict[str, DataFrame]:
    """``results``: a page of blocks by rank, with document, first line, marked text, and in each row total, offset, limit and has_more; ``cards``; ``wiki``; ``miss``."""
    planner = planner or Planner()
    hits = _found(shelf, planner, query, filters)
    total = hits.agg(F.count("*").alias("total"))
    page = search.page_of(hits, limit, offset)
    d = shelf.docs.select(F.col("id").alias("doc_id"), "filename", F.coalesce("title", "filename").alias("title"), "cite_key")
    lines = shelf.lines.join(page.select(search.KEY), search.KEY, "left_semi")
    text = lines.groupBy(search.KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "text"))), lambda r: r["text"]), " ").alias("t"), F.min("id").alias("line_id"))
    rows = page.select(*search.KEY, "rank").join(text, search.KEY).join(d, "doc_id").join(F.broadcast(total))  # one row by construction
    marked = highlight(F.col("t"), planner.highlight_terms(query))
    more = F.col("total") > F.lit(offset + limit)
    results = rows.select(*search.KEY, "line_id", "filename", "title", "cite_key", marked.alias("text"), "total", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), more.alias("has_more"), "rank")
    miss = total.filter("total = 0").select(F.lit(query.strip()).alias("query"), F.lit("web").alias("source")) if "doc_id" not in filters else total.filter("false").select(F.lit("").alias("query"), F.lit("web").alias("source"))
    return {"results": results.orderBy("rank", *search.KEY).drop("rank"), "cards": side_hits.card_hits(shelf.cards, planner, query), "wiki": side_hits.wiki_hits(shelf.wiki, planner, query), "miss": miss}


def page_of_groups(shelf: Shelf, query: str, planner: Planner | None = None, limit: int = 200, **filters) -> dict[str, DataFrame]:
    """``groups``: documents by hits, with total_blocks, total_docs and whether the list is cut; side groups; ``event``: the row to log.

    Where the whole query names an entity, its other names widen the search.
    """
    planner = planner or Planner()
    names = search.name_expansions(shelf.names, shelf.entities, planner, query)
    hits = _found(shelf, planner, query, filters, names)
    totals = search.count_hits(hits).select(F.col("total").alias("total_blocks"), F.col("docs").alias("total_docs"))
    groups = search.grouped(hits, shelf.docs).limit(limit).join(F.broadcast(totals))  # one row by construction
    groups = groups.withColumn("groups_truncated", F.col("total_docs") >= limit)
    side = {
        "cards": side_hits.card_hits(shelf.cards, planner, query), "wiki": side_hits.wiki_hits(shelf.wiki, planner, query),
        "entities": side_hits.entity_hits(shelf.entities, shelf.names, shelf.mentions, planner, query), "notes": side_hits.annotation_hits(shelf.notes, shelf.docs, planner, query, 20),
    }
    event = totals.select(F.lit(query).alias("query"), "total_docs", F.lit(bool(names)).alias("expanded"))
    for group, column in (("entities", "entity_hits"), ("wiki", "wiki_hits"), ("cards", "card_hits")):
        event = event.join(F.broadcast(side[group].agg(F.count("*").alias(column))))  # one row by construction
    return {"groups": groups, **side, "event": event.withColumn("clicked", F.lit(False))}


def hits_in_document(shelf: Shelf, doc_id: int, query: str, planner: Planner | None = None, limit: int = 300) -> DataFrame:
    """Hits of one document in reading order: place, first line, marked snippet (80 characters from 30 before the word), total and whether the list is cut."""
    planner = planner or Planner()
    names = search.name_expansions(shelf.names, shelf.entities, planner, query)
    found = search.search(shelf.blocks, shelf.docs, shelf.lines, query, planner, names, ranked=False, doc_id=doc_id)
    hits = search.doc_hits(found, shelf.lines, doc_id)
    total = hits.agg(F.count("*").alias("total"))
    t = F.trim("line_text")
    at = F.instr(F.lower(t), query.lower())
    start = F.greatest(at - 30, F.lit(1))
    cut = F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), F.substring(t, start, F.lit(80)), F.lit("…"))).otherwise(F.concat(F.substring(t, 1, 80), F.lit("…")))
    snippet = highlight(F.when(F.length(t) > 80, cut).otherwise(t), planner.highlight_terms(query))
    rows = hits.orderBy("page_num", "block_num").limit(limit).join(F.broadcast(total))  # one row by construction
    return rows.select("page_num", "block_num", "line_id", snippet.alias("snippet"), "total", (F.col("total") > limit).alias("truncated"))
