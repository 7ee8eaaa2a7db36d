"""Sharding by extendible hashing.

A row's hash is the first 60 bits of the MD5 of its id. The directory is indexed
by leading bits of it; a bucket that is over the byte limit splits on its next
bit, and no other bucket does. Sums per cell (a prefix a few bits longer than an
even split would need) give the sums of all shorter prefixes; only the rows of
cells that are still too large are summed again, eight bits deeper.

A shard over the limit is possible in one case only: all its rows have the same
hash, i.e. one row is larger than the limit or rows repeat an id. Null ids share
the hash of the empty string; null texts have no bytes. An empty table gives no rows.
Rows are kept whole in a struct, so that no column of theirs clashes with another.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize

BITS = 60


def _hash(id_col) -> F.Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def directory(cells: DataFrame, depth: int, limit: int, shallowest: int) -> DataFrame:
    """Cells (prefix of ``depth`` bits, bytes, n, lo, hi) -> the shard of each, null where it must be split deeper."""
    up = cells.select("*", F.explode(F.sequence(F.lit(shallowest), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftright(cell, {depth} - d)"))
    nodes = up.groupBy("d", "p").agg(*(F.sum(c).alias(c) for c in ("bytes", "n")), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fit = nodes.filter((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "p", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))
    found = up.select("cell", "d", "p").join(fit, ["d", "p"]).groupBy("cell").agg(F.min(F.struct("d", "p", "shard_bytes", "shard_rows")).alias("shard"))
    return cells.select("cell").join(found, "cell", "left")


def shard_rows(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int = 8) -> DataFrame:
    """row (the whole input row), n_bytes, shard_bits, shard (leading bits as text), shard_bytes, shard_rows."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    base = docs.select(F.struct(*docs.columns).alias("row"), _hash(F.col(id_col)).alias("h"), size.alias("n_bytes"))
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(24, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    tables, shallowest, rows = [], 0, base
    while True:
        cell = F.shiftright("h", BITS - depth)
        cells = rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        found = materialize(directory(cells, depth, limit, shallowest), f"directory-{depth}")
        tables.append((depth, found))
        if depth == BITS or not (open_ := found.filter("shard IS NULL").select("cell")).take(1):
            break
        rows = rows.withColumn("cell", cell).join(open_, "cell", "left_semi").drop("cell")
        shallowest, depth = depth + 1, min(BITS, depth + step)
    out = base.withColumn("shard", F.lit(None).cast("struct<d:int,p:bigint,shard_bytes:bigint,shard_rows:bigint>"))
    for depth, table in tables:
        known = table.filter("shard IS NOT NULL").select(F.col("cell").alias("at"), F.col("shard").alias("s"))
        out = out.join(known, F.shiftright("h", BITS - depth) == F.col("at"), "left").withColumn("shard", F.coalesce("shard", "s")).drop("at", "s")
    name = F.when(F.col("shard.d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(shard.p), shard.d, '0')"))
    return out.select("row", "n_bytes", F.col("shard.d").cast("long").alias("shard_bits"), name.alias("shard"), "shard.shard_bytes", "shard.shard_rows")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows as they were, written by one task: a shard is no larger than its limit."""
    named = sharded.select("row.*", F.concat(F.lit("s"), "shard").alias("shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
