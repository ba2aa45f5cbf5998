"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_place(spark: SparkSession, kind: str = "table") -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names. Where none is set, a temporary one on a local master, as in tests; on a cluster an error."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-places-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, written and read back: its lineage ends there."""
    path = new_place(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._place = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df``, written as a table in buckets by ``key``, sorted inside, and read back: tables of as many buckets by one key meet without a shuffle.

    One file a bucket and writer: the rows are dealt out by the key first. For joins and windows on more columns than
    the key, ``co_partitioned`` lets Spark use the buckets too.
    """
    path = new_place(df.sparkSession, "bucketed")
    name = f"bucketed_{path.rsplit('-', 1)[1]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def co_partitioned(spark: SparkSession) -> None:
    """From now on rows that are dealt out by some of the keys of a join count as dealt out for it."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote."""
    for df in tables:
        delete(df.sparkSession, df._place)
