"""A folder of files as a source of Spark: its listing as a table, and as a stream of what is new or has changed.

    spark.dataSource.register(FolderSource)
    spark.read.format("folder").load("/shelves")          # all files: collection, name, size, mtime
    spark.readStream.format("folder").load("/shelves")    # files new or changed since the last look

Files stand in a folder for each collection (and there in ``inside``, where that option
is set). A stream's offset is the listing that was seen, some sixty bytes a file, so a
query that starts again from its checkpoint knows what it has had. The listing is taken
where the driver runs; rows come from the offsets and no task looks at the folder. Links,
folders inside a collection's folder and files that go while they are listed are left out.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FILES = "collection string, name string, size long, mtime timestamp"
#: Files of a partition of the listing.
EACH = 10_000


def look(root: str, inside: str = "") -> dict[str, list[int]]:
    """collection/name -> size and time of change in microseconds."""
    found = {}
    with os.scandir(root) as shelves:
        names = sorted(s.name for s in shelves if s.is_dir(follow_symlinks=False) and not s.name.startswith("."))
    for collection in names:
        try:
            with os.scandir(os.path.join(root, collection, inside)) as files:
                for f in files:
                    try:
                        if f.is_file(follow_symlinks=False):
                            stat = f.stat(follow_symlinks=False)
                            found[f"{collection}/{f.name}"] = [stat.st_size, stat.st_mtime_ns // 1000]
                    except FileNotFoundError:
                        continue
        except (FileNotFoundError, NotADirectoryError):
            continue
    return dict(sorted(found.items()))


class Listed(InputPartition):
    def __init__(self, files: list[tuple[str, list[int]]]) -> None:
        super().__init__(files)


def _partitions(files: dict[str, list[int]]) -> list[Listed]:
    rows = sorted(files.items())
    return [Listed(rows[i : i + EACH]) for i in range(0, len(rows), EACH)] or [Listed([])]


def _rows(partition: InputPartition) -> Iterator[tuple]:
    for path, (size, changed) in partition.value:
        collection, _, name = path.partition("/")
        yield collection, name, size, dt.datetime.fromtimestamp(changed // 1_000_000, dt.timezone.utc) + dt.timedelta(microseconds=changed % 1_000_000)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return FILES

    def _look(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("inside", "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(*self._look())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(*self._look())


class FolderReader(DataSourceReader):
    def __init__(self, root: str, inside: str) -> None:
        self.root, self.inside = root, inside

    def partitions(self) -> Sequence[InputPartition]:
        return _partitions(look(self.root, self.inside))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition)


class FolderStream(DataSourceStreamReader):
    def __init__(self, root: str, inside: str) -> None:
        self.root, self.inside = root, inside

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": look(self.root, self.inside)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _partitions({k: v for k, v in end["files"].items() if start["files"].get(k) != v})

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition)


def listing(spark: SparkSession, root: str, inside: str = "") -> DataFrame:
    """collection, name, size, mtime, seen_at of all files now."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("inside", inside).load(root).withColumn("seen_at", F.current_timestamp())


def listings(spark: SparkSession, root: str, inside: str = "") -> DataFrame:
    """Streaming: the same of files that are new or have changed since the last look."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder").option("inside", inside).load(root).withColumn("seen_at", F.current_timestamp())
