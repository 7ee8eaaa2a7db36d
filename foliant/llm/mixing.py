"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

Documents hang in a tree domain -> language -> source. A node's token budget is
dealt to its children by weight; a child can take ``max_epochs`` times its own
tokens at most, and what it can't take goes to its siblings by their weights.
Only when all children of a node are full does the shortage show as the node's
own capacity, and so reach the node's siblings. Each leaf takes whole epochs and
then the longest prefix, in the seeded order of its next epoch, that fits.

The prefix of a leaf is found without sorting the leaf: tokens are summed by the
leading hex digits of the order key, the sums are accumulated, and only the one
bucket that the budget ends in is sorted. The number of digits follows the
largest leaf, so that a bucket holds some ten thousand rows.

Null language or source stands as ``und`` and ``none``; null or empty texts have
no tokens and are taken with the prefix they stand in. Rows that repeat an id
are interchangeable. An empty table gives an empty result. Column names of the
input can't clash with working columns, as whole rows travel in one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialize

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """Domain of a source: its number modulo four; sources without a number share one domain."""
    digits = F.regexp_extract(source, "([0-9]{1,9})", 1)
    return F.when(digits != "", F.concat(F.lit("domain"), (digits.cast("long") % 4).cast("string"))).otherwise("domain-other")


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), F.col(level)) if pairs else F.lit(None)
    return F.coalesce(known, F.lit(1)).cast("decimal(9,0)")


def _deal(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Share of each node (cap, w, budget of its parent): by weight, held to cap, the rest to its siblings.

    Siblings in order of cap / w: one is full if what the full ones before it
    leave, dealt by weight, covers its cap.
    """
    group = Window.partitionBy(*[F.col(p) for p in parents] or [F.lit(0)])
    before = group.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), name).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    x = nodes.withColumns({"w_from": F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), zero), "cap_before": F.coalesce(F.sum("cap").over(before), zero)})
    x = x.withColumn("is_full", F.expr("cap * cast(w_from AS decimal(12,0)) <= cast(budget - cap_before AS decimal(20,0)) * w"))
    x = x.withColumns({"cap_full": F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(group), zero), "w_open": F.sum(F.when(~F.col("is_full"), F.col("w"))).over(group)})
    share = F.expr("CASE WHEN is_full THEN cap ELSE cast((cast(budget - cap_full AS decimal(20,0)) * w) div w_open AS decimal(20,0)) END")
    return x.select(*parents, name, share.alias("share"))


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens) -> the same with its budget ``share``."""
    caps = leaves.select(*LEVELS, "tokens", (F.col("tokens").cast("decimal(20,0)") * max_epochs).cast("decimal(20,0)").alias("cap"))
    above, parents = None, []
    for level in LEVELS:
        nodes = caps.groupBy(*parents, level).agg(F.sum("cap").cast("decimal(20,0)").alias("cap")).withColumn("w", _weight(level, weights.get(level, {})))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("decimal(20,0)"))
        else:
            nodes = nodes.join(above.withColumnRenamed("share", "budget"), parents)
        above = _deal(nodes, list(parents), level)
        parents.append(level)
    return caps.drop("cap").join(above, parents)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, dict[str, int]],
    budget_percent: int = 60,
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain=domain_of,
    bucket_rows: int = 10_000,
) -> DataFrame:
    """row (the whole input row), domain, lang, source, n_tokens, epoch: one row for each copy taken."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("none"))
    base = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).cast("string").alias("id"), domain(source).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), source.alias("source"), token_estimate(F.col(text_col).cast("string")).alias("n_tokens"),
    )
    leaves = materialize(base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    total, most = leaves.agg(F.sum("tokens"), F.max("rows")).first()
    shares = leaf_budgets(leaves, (total or 0) * budget_percent // 100, max_epochs, weights)
    # whole epochs, and the tokens of the next one; a leaf of no tokens takes its rows once
    plan = shares.select(*LEVELS, F.expr("CASE WHEN tokens = 0 THEN 1 ELSE share div tokens END").alias("whole"), F.expr("CASE WHEN tokens = 0 THEN 0 ELSE cast(share % tokens AS bigint) END").alias("part"))
    plan = materialize(plan, "leaf-plan")

    digits = min(8, max(1, math.ceil(math.log(max(1, (most or 1) / bucket_rows), 16))))
    keyed = base.join(plan, list(LEVELS)).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), "whole", F.coalesce("id", F.lit(""))).cast("binary")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = keyed.groupBy(*LEVELS, "part", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("in_bucket").over(run))
    ends = materialize(ends.select(*LEVELS, "bucket", "upto", (F.col("upto") - F.col("in_bucket")).alias("below")), "bucket-sums")

    placed = keyed.join(ends, [*LEVELS, "bucket"])
    split = (F.col("below") <= F.col("part")) & (F.col("upto") > F.col("part"))
    order = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.filter(split).withColumn("taken", (F.col("below") + F.sum("n_tokens").over(order) <= F.col("part")))
    outer = placed.filter(~split).withColumn("taken", F.col("upto") <= F.col("part"))
    copies = inner.union(outer).withColumn("copies", F.col("whole") + (F.col("taken") & (F.col("part") > 0)).cast("int")).filter("copies > 0")
    return copies.select("row", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("epoch"))
