import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "checkpoints"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same_rows(spark_df, duck_relation):
    """Both results as sorted rows of text, by column name; doubles to six digits."""

    def rows(pdf):
        pdf = pdf[sorted(pdf.columns)].copy()
        for c in pdf.columns:
            if pdf[c].dtype.kind in "fiu" or str(pdf[c].dtype).startswith("Int"):
                pdf[c] = pdf[c].astype(float).round(6)
        text = pdf.astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
        return list(text.columns), sorted(map(tuple, text.itertuples(index=False)))

    return rows(spark_df.toPandas()), rows(duck_relation.df())
