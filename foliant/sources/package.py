"""Collections as folders: export, import, merging; names and orphans. A table is a parquet folder partitioned by collection."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.mutate import import_children, import_documents, manifest, package
from foliant.sources.scratch import written

_NAME = re.compile(r"^[^\s/\\.][^/\\]{0,63}$")


def valid_name(name: str) -> bool:
    """A collection's name: no separators, no leading dot or space, at most 64 characters."""
    return bool(_NAME.match(name or "")) and name.strip() == name


def export_documents(tables: dict[str, DataFrame], ids: DataFrame, folder: str, changeset: bool = False) -> None:
    """The documents' rows of each table, and a manifest of base versions, as parquet under ``folder``."""
    own = package(tables, ids, changeset)
    for name, t in own.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest(own).withColumn("kind", F.lit("changeset" if changeset else "documents")).write.mode("overwrite").json(f"{folder}/manifest")


def read_package(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def merge_package(have: dict[str, DataFrame], come: dict[str, DataFrame], force: bool = False) -> dict[str, DataFrame]:
    """Both collections as one: documents that are there are skipped (with ``force`` they come in beside them), the others' rows get their new ids. Tables of one side alone are kept."""
    docs, ids = import_documents(have["documents"], come["documents"], force)
    ids = written(ids, "new-ids")
    out = {"documents": docs}
    for name in dict.fromkeys([*have, *come]):
        if name != "documents":
            t = have.get(name)
            own = come.get(name)
            if own is None or "doc_id" not in own.columns:
                out[name] = t if t is not None else own
            else:
                out[name] = import_children(own.limit(0) if t is None else t, own, ids)
    return out


def attach_changeset(have: dict[str, DataFrame], come: dict[str, DataFrame]) -> DataFrame:
    """Revisions of a changeset on the documents of the same cite key; ones that are there already are skipped."""
    ids = come["documents"].select(F.col("id").alias("old_id"), "cite_key").join(have["documents"].select(F.col("id").alias("new_id"), "cite_key"), "cite_key").select("old_id", "new_id")
    old = have["revision_log"]
    moved = come["revision_log"].join(ids, F.col("doc_id") == F.col("old_id")).withColumn("doc_id", F.col("new_id")).drop("old_id", "new_id")
    key = ["doc_id", "page_num", "block_num", "old_value", "new_value"]
    return old.unionByName(moved.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def write_collection(t: DataFrame, path: str) -> None:
    """Replaces the partitions of the collections in ``t`` and no others."""
    t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def collections(t: DataFrame) -> DataFrame:
    return t.select("collection").distinct()


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Child tables' rows whose document is gone: table, doc_id, rows."""
    ids = tables["documents"].select(F.col("id").alias("doc_id"))
    out = None
    for name, t in tables.items():
        if name != "documents":
            part = t.join(ids, "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "doc_id", "rows")
            out = part if out is None else out.union(part)
    return out


def read_config(text: str, default: dict) -> dict:
    """A configuration text over its defaults; unknown keys and bad JSON are left out."""
    try:
        own = json.loads(text or "{}")
    except ValueError:
        own = {}
    return default | {k: v for k, v in own.items() if k in default} if isinstance(own, dict) else default
