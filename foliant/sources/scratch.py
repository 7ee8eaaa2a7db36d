"""Written tables that cut lineage, and numbering of rows without a task that sees them all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; the warehouse where it is unset and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/foliant"


def stamps(df: DataFrame) -> list[tuple[str, int, int]]:
    """Name, length and time of change of each file that a table is read from."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in sorted(df.inputFiles())]
    found = [p.getFileSystem(conf).getFileStatus(p) for p in paths]
    return [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]


def written(df: DataFrame, label: str, packed: bool = False) -> DataFrame:
    """The table, written to the shared folder and read back; tables of texts are packed tighter."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if packed else None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Rows with their place (from 1) in the order, which must be total.

    Range partitions are numbered each by itself; the start of each is a running sum
    over one row a partition.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    start = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    start = start.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, place).join(F.broadcast(start), "_part").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_part", "_start")


def started(df: DataFrame, order: list[str], size: str, name: str = "start") -> DataFrame:
    """Rows with the sum of the sizes of all rows before them in the order, which must be total; ranges as in ``numbered``."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    start = parts.groupBy("_part").agg(F.sum(size).alias("_size"))
    start = start.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_from"))
    before = F.sum(size).over(Window.partitionBy("_part").orderBy(*order)) - F.col(size)
    return parts.withColumn(name, before).join(F.broadcast(start), "_part").withColumn(name, (F.col(name) + F.col("_from")).cast("long")).drop("_part", "_from")
