"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of this machine stands in for it only where the master is local (tests, a
    laptop); on a cluster the setting is required.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="freshet-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts lineage, keeps only one copy per use, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/freshet-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", heavy: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row for each ``key`` and ``n``, the number of rows with it.

    Keys with over 1 / ``heavy`` of all rows are fewer than ``heavy``, so they are broadcast,
    whatever the sizes; the others' rows are shuffled, and no task gets a heavy key. ``how``
    is inner or left. ``keyed`` is written once; ``rows`` is read twice.
    """
    keyed = stored(keyed)
    total = keyed.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") * heavy > total
    other = [F.col(c) for c in keyed.columns if c not in (key, "n")]
    heavy_rows = F.broadcast(keyed.where(many).select(F.col(key).alias("_key"), *other))
    light_rows = keyed.where(~many).select(F.col(key).alias("_key"), *other)
    same = F.col(key) == F.col("_key")
    hot = rows.join(heavy_rows, same)
    cold = rows.join(F.broadcast(keyed.where(many).select(F.col(key).alias("_key"))), same, "left_anti").join(light_rows.hint("shuffle_merge"), same, how)
    return hot.unionByName(cold).drop("_key")
