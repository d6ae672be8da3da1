"""Tables that cut a lineage: written under ``spark.checkpoint.dir``, so that lost executors cost nothing.

They are Parquet and not checkpoints, so that the planner knows the sizes of what it joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own is made only in local sessions that name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tilefold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written to a table of its own and read again; it goes when the application ends.

    ``instead_of``: a stored table that nobody reads any more once this one is written.
    """
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if instead_of is not None:
        release(instead_of)
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a stored table."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def release(df: DataFrame) -> None:
    """Deletes a stored table."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
