"""Full-text search over blocks: phrases and short words, BM25, filters, grouping, context.

Phrases of three characters or more match as substrings after Unicode lower-casing,
in the text or its translation; shorter words match after A-Z folding only. The
score is BM25 over trigram lengths with the statistics of the whole collection,
before any filter: one aggregate gives them all, and comes to the plan as a
one-row side.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ascii_fold, sqlite_year
from foliant.plans.search_plan import Pattern, Planner, SearchPlan

if TYPE_CHECKING:
    from foliant.operators.gram_index import GramIndex

K1, B = 1.2, 0.75


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _holds(phrase: str, columns: list[str]) -> Column:
    if isinstance(phrase, Pattern):
        return _any([F.coalesce(F.col(c).rlike(f"(?iu){phrase}"), F.lit(False)) for c in columns])
    return _any([F.coalesce(F.contains(F.lower(F.col(c)), F.lit(phrase.lower())), F.lit(False)) for c in columns])


def _like(word: str, columns: list[str]) -> Column:
    folded = word.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return _any([F.coalesce(F.contains(ascii_fold(F.col(c)), F.lit(folded)), F.lit(False)) for c in columns])


def matches(plan: SearchPlan, columns: tuple[str, ...] = ("index_text", "trans")) -> Column:
    cols = list(columns)
    if plan.empty:
        return F.lit(False)
    if plan.any_name:
        return _any([_holds(p, cols) for p in plan.any_name])
    return _all([_any([_holds(p, cols) for p in g]) for g in plan.phrases] + [_any([_like(w, cols) for w in g]) for g in plan.short])


def variant_predicate(planner: Planner, query: str, columns: list[str]) -> Column:
    """Short-word matching of a whole query over any columns: for notes, pages and names."""
    query = (query or "").strip()
    groups = [_any([_like(f, columns) for f in planner.plan(t).short[0]]) if len(t) < 3 else _any([_like(f, columns) for f in planner.plan(t).phrases[0]]) for t in planner.tokens(query) or ([query] if query else [])]
    return _all(groups) if groups else F.lit(False)


def occurrences(c: Column, phrase: str) -> Column:
    """Overlapping places of a phrase: a look-ahead matches at each of them."""
    own = f"(?iu)(?={phrase})" if isinstance(phrase, Pattern) else f"(?=\\Q{phrase.lower()}\\E)"
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(own))


def gram_length(text: str = "index_text", trans: str = "trans") -> Column:
    return _sum([F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)) for c in (text, trans)])


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def _all_of(lists: list[Column]) -> Column:
    return reduce(F.array_intersect, lists)


def _any_of(lists: list[Column]) -> Column:
    return reduce(F.array_union, lists)


def idf(n: int, own: int) -> float:
    value = math.log((n - own + 0.5) / (own + 0.5))
    return value if value > 0 else 1e-6


def saturated(f: Column, length: Column, average) -> Column:
    """The part of a phrase's score that its places in a block and the block's length make."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def term_score(phrase: str, average) -> Column:
    return saturated(occurrences(F.col("index_text"), phrase) + occurrences(F.col("trans"), phrase), gram_length(), average)


def with_rank(blocks: DataFrame, plan: SearchPlan, totals: tuple[int, int] | None = None) -> DataFrame:
    """Matching blocks with ``rank`` (lower is better); 0 where the plan has no phrase.

    Where ``totals`` are given (blocks and their gram lengths, of the whole collection), ``blocks``
    need only be those that hold some phrase.
    """
    phrases = plan.scored
    hits = blocks.filter(matches(plan))
    if not phrases:
        return hits.withColumn("rank", F.lit(0.0))
    cols = ["index_text", "trans"]
    whole = [F.count("*").alias("_n"), F.avg(gram_length()).alias("_len")] if totals is None else [F.lit(totals[0]).alias("_n"), F.lit(totals[1] / max(1, totals[0])).alias("_len")]
    stats = blocks.agg(F.count_if(_holds(phrases[0], cols)).alias("_n0"), *whole, *[F.count_if(_holds(p, cols)).alias(f"_n{i + 1}") for i, p in enumerate(phrases[1:])])
    hits = hits.join(F.broadcast(stats))  # one row by construction

    def score(i: int, p: str) -> Column:
        idf = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        return F.when(idf > 0, idf).otherwise(1e-6) * term_score(p, F.col("_len"))

    return hits.withColumn("rank", -_sum([score(i, p) for i, p in enumerate(phrases)])).drop("_n", "_len", *[f"_n{i}" for i in range(len(phrases))])


KEY = ["doc_id", "page_num", "block_num"]


def filtered(
    hits: DataFrame, docs: DataFrame, lines: DataFrame, source_type: str | None = None, doc_id: int | None = None,
    label: list[str] | None = None, exclude: list[str] | None = None, year_from: int | None = None, year_to: int | None = None, year_source: str = "date",
) -> DataFrame:
    """Hits by source type, document, labels of any line of the block and year. Labels to keep win over labels to drop."""
    d = docs
    if source_type in ("primary", "secondary", "reference"):
        d = d.filter(F.array_contains("source_tags", source_type))
    if year_from is not None or year_to is not None:
        date = F.col("bib_date") if year_source == "date" else F.coalesce("bib_date", "bib_year")
        year = sqlite_year(date)
        d = d.filter(_all([year >= year_from] * (year_from is not None) + [year <= year_to] * (year_to is not None)))
    if d is not docs:  # blocks go with their documents: no join where none is filtered
        hits = hits.join(d.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    if doc_id is not None:
        hits = hits.filter(F.col("doc_id") == doc_id)
    if "labels" in hits.columns:  # a block that knows the labels of its lines
        if label:
            hits = hits.filter(F.exists("labels", lambda x: x.isin(label)))
        elif exclude:
            hits = hits.filter(F.exists("labels", lambda x: x.isNull() | ~x.isin(exclude)))
    elif label:
        hits = hits.join(lines.filter(F.col("block_label").isin(label)).select(KEY), KEY, "left_semi")
    elif exclude:
        hits = hits.join(lines.filter(F.col("block_label").isNull() | ~F.col("block_label").isin(exclude)).select(KEY), KEY, "left_semi")
    return hits


def page_of(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return hits.orderBy("rank", *KEY).offset(offset).limit(limit)


def count_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"), F.count_distinct("doc_id").alias("docs"))


def grouped(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits and best rank of each document, most hits first."""
    g = hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best_rank"))
    return g.join(docs.select(F.col("id").alias("doc_id"), "title", "source_tags"), "doc_id").orderBy(F.desc("hits"), "best_rank", "doc_id")


def first_lines(lines: DataFrame) -> DataFrame:
    """First line of each block, by id."""
    return lines.groupBy(KEY).agg(F.min("id").alias("line_id"), F.min_by("text", "id").alias("line_text"))


def doc_hits(hits: DataFrame, lines: DataFrame, doc_id: int) -> DataFrame:
    """Hits inside one document, in reading order, with the first line of each block."""
    own = lines.filter(F.col("doc_id") == doc_id)
    return hits.filter(F.col("doc_id") == doc_id).join(first_lines(own), KEY).orderBy("page_num", "block_num")


def context(blocks: DataFrame, hits: DataFrame, radius: int) -> DataFrame:
    """Blocks of the same page at most ``radius`` blocks away, for many hits at once."""
    h = hits.select("doc_id", "page_num", F.col("block_num").alias("hit_block"))
    near = h.withColumn("block_num", F.explode(F.sequence(F.col("hit_block") - radius, F.col("hit_block") + radius)))
    return near.join(blocks, KEY).select("doc_id", "page_num", "hit_block", "block_num", "index_text")


def interleave(ranked: DataFrame, shelf: str = "collection", per_shelf: int = 10) -> DataFrame:
    """Round-robin merge of the best hits of each collection."""
    w = Window.partitionBy(shelf).orderBy("rank", *KEY)
    return ranked.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= per_shelf).orderBy("turn", shelf)


def name_expansions(names: DataFrame, entities: DataFrame, planner: Planner, query: str, limit: int = 8) -> list[str]:
    """Other names of entities that the whole query names; at most ``limit`` names are followed."""
    q = "".join((query or "").split())
    if len(q) < 2:
        return []
    ids = names.filter(variant_predicate(planner, q, ["name"])).orderBy("entity_id", "name").limit(limit).select("entity_id").distinct()
    rows = entities.join(ids, F.col("id") == F.col("entity_id"), "left_semi").orderBy("id").select("canonical", "aliases").collect()
    found = [n.strip() for r in rows for n in [r.canonical, *(r.aliases or [])] if n and n.strip() and "".join(n.split()) != q]
    return list(dict.fromkeys(found))


def search(blocks: DataFrame | GramIndex, docs: DataFrame, lines: DataFrame, query: str, planner: Planner | None = None, names: list[str] | None = None, ranked: bool = True, **filters) -> DataFrame:
    """Blocks of a query, with their rank unless only the set is asked for; an empty plan gives no rows.

    ``blocks`` is an index, of which the grams of the query are read, or a table, which is read whole.
    """
    plan = (planner or Planner()).plan(query, names)
    if not isinstance(blocks, DataFrame):
        hits = blocks.hits(plan, ranked)
    else:
        hits = with_rank(blocks, plan) if ranked else blocks.filter(matches(plan))
    return filtered(hits, docs, lines, **filters)


def top(index: GramIndex, docs: DataFrame, lines: DataFrame, query: str, k: int, planner: Planner | None = None, names: list[str] | None = None, **filters) -> DataFrame:
    """KEY of the k best blocks of a query in order, with their place ``nth``, without ranking all."""
    return index.best((planner or Planner()).plan(query, names), k, lambda hits: filtered(hits, docs, lines, **filters))
