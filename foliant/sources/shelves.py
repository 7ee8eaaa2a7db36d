"""Shelves: collections as folders of tables that are published whole, and their import in two stages.

A shelf is a folder with a version for each state of its tables. An import is staged
first: its tables are copied beside the shelves, checked, and compared with the
shelf of the same name. What would clash is told before anything is changed. Then it is
published in one of three ways, by one version that names the new tables: a
publication that fails leaves the shelf as it was, and a reader never sees half of one.

* ``create``: a new shelf; refused if there is one;
* ``overwrite``: the package's tables in place of the shelf's;
* ``merge``: documents whose cite key or file name is there already are skipped, others
  come in with new ids and all their rows.

Deleting and renaming are versions too; the files of old versions stay until the
folder's owner clears them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.mutate import newcomers
from foliant.sources import versions
from foliant.sources.package import merge_package, orphans, valid_name

#: Columns that a package's documents must have.
NEEDED = {"id", "cite_key", "filename"}
#: Where stages wait, beside the shelves.
STAGES = ".stages"


class Refused(ValueError):
    """What was asked for can't be done as things stand; nothing was changed."""


def tables(spark: SparkSession, root: str, shelf: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a shelf as they stand, or stood at a version."""
    told = _told(spark, root, shelf, version)
    if told is None or told["deleted"]:
        raise FileNotFoundError(f"no shelf {shelf}")
    return {name: spark.read.parquet(path) for name, path in told["tables"].items()}


def _told(spark: SparkSession, root: str, shelf: str, version: int | None = None) -> dict | None:
    if not versions.numbers(spark, f"{root}/{shelf}"):
        return None
    number, told = versions.read(spark, f"{root}/{shelf}", version)
    return told | {"version": number}


def is_there(spark: SparkSession, root: str, shelf: str) -> bool:
    told = _told(spark, root, shelf)
    return told is not None and not told["deleted"]


def shelves(spark: SparkSession, root: str) -> list[str]:
    """Names of the shelves that are there."""
    return [n for n in versions.names_in(spark, root) if not n.startswith(".") and is_there(spark, root, n)]


def _publish(spark: SparkSession, root: str, shelf: str, paths: dict[str, str], deleted: bool = False) -> int:
    told = _told(spark, root, shelf)
    number = (told["version"] if told else 0) + 1
    versions.publish(spark, f"{root}/{shelf}", number, {"tables": paths, "deleted": deleted})
    return number


def _write(data: dict[str, DataFrame], folder: str) -> dict[str, str]:
    for name, t in data.items():
        t.write.parquet(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in data}


def create(root: str, shelf: str, data: dict[str, DataFrame]) -> int:
    """A new shelf of these tables; its version."""
    spark = data["documents"].sparkSession
    if not valid_name(shelf):
        raise Refused(f"no name for a shelf: {shelf!r}")
    if is_there(spark, root, shelf):
        raise Refused(f"there is a shelf {shelf}")
    return _publish(spark, root, shelf, _write(data, f"{root}/{shelf}/data/{uuid.uuid4().hex[:12]}"))


def delete(spark: SparkSession, root: str, shelf: str) -> int:
    if not is_there(spark, root, shelf):
        raise Refused(f"no shelf {shelf}")
    return _publish(spark, root, shelf, {}, deleted=True)


def rename(spark: SparkSession, root: str, shelf: str, new: str) -> None:
    """The tables stay where they are; the new name is published before the old one is given up."""
    told = _told(spark, root, shelf)
    if told is None or told["deleted"]:
        raise Refused(f"no shelf {shelf}")
    if not valid_name(new) or new == shelf:
        raise Refused(f"no new name for a shelf: {new!r}")
    if is_there(spark, root, new):
        raise Refused(f"there is a shelf {new}")
    _publish(spark, root, new, told["tables"])
    delete(spark, root, shelf)


def export(spark: SparkSession, root: str, shelf: str, folder: str) -> dict:
    """The whole shelf as a package: its tables and a manifest with their rows."""
    data = tables(spark, root, shelf)
    told = {"kind": "shelf", "collection": shelf, "rows": {name: t.count() for name, t in data.items()}}
    _write(data, folder)
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return told


# --- import -----------------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """A package that was read, checked and copied, and what it would meet on its shelf."""

    spark: SparkSession
    root: str
    name: str
    shelf: str
    #: documents, shelf_is_there, ways, clashes (documents that are there already), newcomers, stray_rows (of no document), new_tables, lost_tables (if overwritten)
    report: dict

    @property
    def folder(self) -> str:
        return f"{self.root}/{STAGES}/{self.name}"

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.folder}/data/{n}") for n in self.report["rows"]}

    def clashes(self) -> DataFrame:
        """Documents of the package that are on the shelf already, with the cite key or file name that tells."""
        return _clashes(tables(self.spark, self.root, self.shelf)["documents"] if self.report["shelf_is_there"] else None, self.tables()["documents"])

    def publish(self, how: str) -> int:
        """Puts the package on its shelf: create, overwrite or merge. A stage can be published once; after a failure, again."""
        there = is_there(self.spark, self.root, self.shelf)
        if how not in ("create", "overwrite", "merge"):
            raise Refused(f"no such way: {how}")
        if (how == "create") == there:
            raise Refused(f"there is {'a' if there else 'no'} shelf {self.shelf}")
        if versions.exists(self.spark, f"{self.folder}/used"):
            raise Refused("this stage was published before")
        data = self.tables()
        if how == "merge":
            data = merge_package(tables(self.spark, self.root, self.shelf), data)
        paths = _write(data, f"{self.root}/{self.shelf}/data/{uuid.uuid4().hex[:12]}")
        wrong = {n for n, rows in self.report["rows"].items() if how != "merge" and self.spark.read.parquet(paths[n]).count() != rows}
        if wrong:
            raise RuntimeError(f"tables were not written whole: {sorted(wrong)}")
        number = _publish(self.spark, self.root, self.shelf, paths)
        self.spark.createDataFrame([(how, number)], "how string, version int").coalesce(1).write.json(f"{self.folder}/used")
        return number


def _clashes(have: DataFrame | None, come: DataFrame) -> DataFrame:
    d = come.select("id", "cite_key", "filename")
    if have is None:
        return d.limit(0).withColumn("by", F.lit(""))
    there = lambda c: have.filter(f"{c} <> ''").select(F.col(c).alias(f"_{c}")).distinct()
    d = d.join(there("cite_key"), F.col("cite_key") == F.col("_cite_key"), "left").join(there("filename"), F.col("filename") == F.col("_filename"), "left")
    by = F.when(F.col("_cite_key").isNotNull(), "cite_key").when(F.col("_filename").isNotNull(), "filename")
    return d.withColumn("by", by).filter("by IS NOT NULL").select("id", "cite_key", "filename", "by")


def stage(spark: SparkSession, root: str, package: str, shelf: str | None = None) -> Stage:
    """Reads a package of a shelf and says what it would do; the shelf stays as it is.

    A package without a readable manifest, without documents or without their columns is refused,
    and so is one whose tables have not the rows that its manifest tells.
    """
    try:
        told = json.loads(spark.read.text(f"{package}/manifest").first().value)
        rows, shelf = told["rows"], shelf or told["collection"]
    except Exception as e:
        raise Refused(f"no manifest of a shelf in {package}") from e
    if not valid_name(shelf):
        raise Refused(f"no name for a shelf: {shelf!r}")
    if "documents" not in rows:
        raise Refused("a package without documents")
    name = uuid.uuid4().hex[:12]
    data = {n: spark.read.parquet(f"{package}/{n}") for n in rows}
    if lacking := NEEDED - set(data["documents"].columns):
        raise Refused(f"documents without {sorted(lacking)}")
    _write(data, f"{root}/{STAGES}/{name}/data")
    copied = {n: spark.read.parquet(f"{root}/{STAGES}/{name}/data/{n}") for n in rows}
    if wrong := {n: t.count() for n, t in copied.items() if t.count() != rows[n]}:
        raise Refused(f"tables with other numbers of rows than told: {wrong}")
    there = is_there(spark, root, shelf)
    have = tables(spark, root, shelf) if there else {}
    clashes = _clashes(have.get("documents"), copied["documents"])
    children = {n: t for n, t in copied.items() if n == "documents" or "doc_id" in t.columns}
    stray = orphans(children) if len(children) > 1 else None
    report = {
        "rows": rows, "shelf_is_there": there, "ways": ["overwrite", "merge"] if there else ["create"],
        "clashes": clashes.count(), "newcomers": newcomers(have["documents"], copied["documents"]).count() if there else rows["documents"],
        "stray_rows": stray.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] if stray is not None else 0,
        "new_tables": sorted(set(rows) - set(have)), "lost_tables": sorted(set(have) - set(rows)),
    }
    spark.createDataFrame([(json.dumps({"shelf": shelf, "report": report}),)], "value string").coalesce(1).write.text(f"{root}/{STAGES}/{name}/told")
    return Stage(spark, root, name, shelf, report)


def opened(spark: SparkSession, root: str, name: str) -> Stage:
    """A stage that waits, by name: staging and publishing may be two sessions."""
    if not versions.exists(spark, f"{root}/{STAGES}/{name}/told"):
        raise Refused(f"no stage {name}")
    told = json.loads(spark.read.text(f"{root}/{STAGES}/{name}/told").first().value)
    return Stage(spark, root, name, told["shelf"], told["report"])
