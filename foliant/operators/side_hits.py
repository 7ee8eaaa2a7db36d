"""What a search shows beside the blocks: cards, wiki pages, entities, annotations; and notes of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import snippet
from foliant.operators.entities import mention_counts
from foliant.operators.search import matches, variant_predicate
from foliant.plans.search_plan import Planner


def card_hits(cards: DataFrame, planner: Planner, query: str, top: int = 20) -> DataFrame:
    """Reviewed cards (id, doc_id, title, content) that the plan matches first, then those that hold the query's forms anywhere."""
    c = cards.withColumns({"index_text": F.concat_ws(" ", "title", "content"), "trans": F.lit(None).cast("string")})
    first = c.filter(matches(planner.plan(query))).withColumn("turn", F.lit(0))
    more = c.filter(variant_predicate(planner, query, ["title", "content"])).join(first.select("id"), "id", "left_anti").withColumn("turn", F.lit(1))
    return first.unionByName(more).orderBy("turn", "id").limit(top).select("id", "doc_id", "title", snippet(F.col("content"), query, 40, 120, 200).alias("snippet"))


def wiki_hits(pages: DataFrame, planner: Planner, query: str, top: int = 10) -> DataFrame:
    """Wiki pages (id, slug, title, content) with every word of the query in title or content."""
    return pages.filter(variant_predicate(planner, query, ["title", "content"])).orderBy("id").limit(top).select("id", "slug", "title", snippet(F.col("content"), query, 20, 60, 80).alias("snippet"))


def entity_hits(entities: DataFrame, names: DataFrame, mentions: DataFrame, planner: Planner, query: str, top: int = 10) -> DataFrame:
    """Entities with a name that holds the query, most mentioned first."""
    ids = names.filter(variant_predicate(planner, query, ["name"])).select(F.col("entity_id").alias("id")).distinct()
    return mention_counts(entities.join(ids, "id", "left_semi"), mentions).orderBy(F.desc("mentions"), "entity_id").limit(top)


def annotation_hits(notes: DataFrame, docs: DataFrame, planner: Planner, query: str, top: int = 50) -> DataFrame:
    """Notes and clipped texts that hold the query, newest first; at most 200."""
    d = docs.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"))
    return notes.filter(variant_predicate(planner, query, ["note", "clip_text"])).join(d, "doc_id").orderBy(F.desc("updated_at"), F.desc("id")).limit(min(top, 200))


def page_notes(notes: DataFrame) -> DataFrame:
    """Notes of each page as one text: the clipped text in brackets, an arrow, the note."""
    clip = F.when(F.coalesce("clip_text", F.lit("")) != "", F.concat(F.lit("「"), F.substring("clip_text", 1, 80), F.lit("」"))).otherwise("")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" → "), F.substring("note", 1, 200))).otherwise("")
    n = notes.withColumn("t", F.concat(clip, note)).filter("t <> ''")
    return n.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda r: r["t"]), "\n").alias("notes"))


def filtered_entities(entities: DataFrame, era: str | None = None, scope: str | None = None, year: int | None = None) -> DataFrame:
    """Entities by substrings of their era and scope, and by a year inside their bounds; a bound may be missing, but not both."""
    p = lambda k: F.try_element_at("props", F.lit(k))
    e = entities
    if era:
        e = e.filter(F.contains(F.coalesce(F.nullif(p("era"), F.lit("")), p("朝代"), F.lit("")), F.lit(era)))
    if scope:
        e = e.filter(F.contains(F.coalesce(p("scope"), F.lit("")), F.lit(scope)))
    if year is not None:
        lo, hi = p("year_start"), p("year_end")
        inside = F.coalesce(lo.try_cast("int") <= year, F.lit(True)) & F.coalesce(hi.try_cast("int") >= year, F.lit(True))
        e = e.filter((lo.isNotNull() | hi.isNotNull()) & inside)
    return e
