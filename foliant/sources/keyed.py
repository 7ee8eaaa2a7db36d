"""Tables with a key that change in place: by bucket of the key, copy on write.

Rows lie in buckets by the hash of their key. A change reads and writes the buckets of
the keys that it has, as new files, and publishes a version that names these in place of
the old ones; files of other buckets stay as they are. A version also keeps the number
of the last batch of each stream that was put in, so a batch that runs again after a
failure changes nothing.

Key columns may be null: a null equals a null. The keys of one change must be different;
if they aren't, the change is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.sources import versions
from foliant.sources.scratch import written

#: Buckets of a table whose size isn't known.
BUCKETS = 32


@dataclass(frozen=True)
class KeyedTable:
    """One version of a table; changes return the next one."""

    spark: SparkSession
    root: str
    version: int
    key: tuple[str, ...]
    schema: StructType
    #: Folder of each bucket that has rows.
    files: dict[int, str]
    buckets: int
    batches: dict[str, int]

    @classmethod
    def created(cls, df: DataFrame, root: str, key: list[str], buckets: int = BUCKETS) -> KeyedTable:
        empty = cls(df.sparkSession, root, 0, tuple(key), df.schema, {}, buckets, {})
        return empty._changed(df, lambda old, new: new)

    @classmethod
    def opened(cls, spark: SparkSession, root: str, version: int | None = None) -> KeyedTable:
        number, told = versions.read(spark, root, version)
        return cls(spark, root, number, tuple(told["key"]), StructType.fromJson(told["schema"]), {int(b): f for b, f in told["files"].items()}, told["buckets"], told["batches"])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = [f"{self.root}/data/{f}/bucket={b}" for b, f in sorted(self.files.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def where(self, values: dict) -> DataFrame:
        """Rows of one key, of which one bucket is read."""
        one = self.spark.createDataFrame([tuple(values[k] for k in self.key)], StructType([self.schema[k] for k in self.key]))
        bucket = one.select(self._bucket().alias("b")).first().b
        return self.rows([bucket]).join(F.broadcast(one.toDF(*[f"_{k}" for k in self.key])), self._same("_"), "left_semi")  # one row

    def _same(self, prefix: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in self.key])

    def _changed(self, new: DataFrame, build: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, batch: int | None = None) -> KeyedTable:
        if stream is not None and batch <= self.batches.get(stream, -1):
            return self
        new = written(new, "changes")
        if new.groupBy(*self.key).count().filter("count > 1").take(1):
            raise ValueError("a change has a key more than once")
        touched = sorted(r.b for r in new.select(self._bucket().alias("b")).distinct().collect())
        files, name = dict(self.files), uuid.uuid4().hex[:12]
        if touched:
            rows = build(self.rows(touched), new).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("bucket", self._bucket())
            rows.repartition(min(len(touched), 1 << 12), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
            full = {int(n.partition("=")[2]) for n in versions.names_in(self.spark, f"{self.root}/data/{name}") if n.startswith("bucket=")}
            files = {b: f for b, f in files.items() if b not in touched} | dict.fromkeys(full, name)
        batches = self.batches if stream is None else self.batches | {stream: batch}
        told = {"key": list(self.key), "schema": self.schema.jsonValue(), "files": files, "buckets": self.buckets, "batches": batches}
        versions.publish(self.spark, self.root, self.version + 1, told)
        return replace(self, version=self.version + 1, files=files, batches=batches)

    def upserted(self, new: DataFrame, **batch) -> KeyedTable:
        """Rows of ``new`` in place of those of the same key."""
        return self._changed(new, lambda old, new: self._without(old, new).unionByName(new, allowMissingColumns=True), **batch)

    def _without(self, old: DataFrame, keys: DataFrame) -> DataFrame:
        return old.join(keys.select(*[F.col(k).alias(f"_{k}") for k in self.key]), self._same("_"), "left_anti")

    def inserted(self, new: DataFrame, **batch) -> KeyedTable:
        """Rows of ``new`` whose key isn't there yet."""
        def build(old: DataFrame, new: DataFrame) -> DataFrame:
            there = old.select(*[F.col(k).alias(f"_{k}") for k in self.key])
            return old.unionByName(new.join(there, self._same("_"), "left_anti"), allowMissingColumns=True)

        return self._changed(new, build, **batch)

    def removed(self, keys: DataFrame, **batch) -> KeyedTable:
        """Without the rows of these keys."""
        return self._changed(keys.select(*self.key).distinct(), self._without, **batch)

    def combined(self, new: DataFrame, how: dict[str, Callable[[Column, Column], Column]], **batch) -> KeyedTable:
        """Rows of ``new`` where the key is new; else each column of ``how`` from the old and the new value, and the others as they were."""
        def build(old: DataFrame, new: DataFrame) -> DataFrame:
            other = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns], F.lit(True).alias("_new"))
            both = old.withColumn("_old", F.lit(True)).join(other, self._same("_"), "full")
            fresh, kept = F.col("_old").isNull(), F.col("_new").isNull()
            value = lambda c: F.when(fresh, F.col(f"_{c}") if c in new.columns else F.lit(None)).when(kept, F.col(c)).otherwise(how[c](F.col(c), F.col(f"_{c}")) if c in how else F.col(c))
            return both.select(*[value(c).alias(c) for c in self.schema.names])

        return self._changed(new, build, **batch)


def into(root: str, stream: str, put: Callable[[KeyedTable, DataFrame, dict], KeyedTable]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``put(table, rows, batch)`` changes the latest version, once for each number of a batch of the stream."""

    def write(rows: DataFrame, number: int) -> None:
        put(KeyedTable.opened(rows.sparkSession, root), rows, {"stream": stream, "batch": number})

    return write
