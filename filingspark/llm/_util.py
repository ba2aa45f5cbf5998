"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F


def shared_dir(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one on a local master, as in tests; on a cluster an error, as executors don't share such folders."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs no rerun. Tables from earlier cuts that nothing reads after this one are ``spent`` and deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/filingspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    discard(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out._place = path
    return out


def discard(*spent: DataFrame) -> None:
    """Delete tables that ``cut`` wrote."""
    for df in spent:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._place)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``max_rows`` rows; beyond that a shuffle join gives the same rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on, so that extra columns of any name can't clash with its own."""
    kinds = dict(docs.dtypes)
    wanted = {"doc_id": "bigint", "text": "string"}
    # a column of the right type stays as it is: a renaming keeps Spark from sharing exchanges
    return docs.select(*(F.col(c) if kinds[c] == k else F.col(c).cast(k).alias(c) for c, k in wanted.items()), *more)


def in_slices(run, rows: int = 1000):
    """``run`` over Arrow batches of at most so many rows. After each of Spark's batches, and at the task's end, Arrow gives the memory back that it keeps for later, so that a worker is no larger than what it holds."""

    def sliced(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def slices():
            for batch in batches:
                for start in range(0, len(batch), rows):
                    yield batch.slice(start, rows)
                del batch
                pa.default_memory_pool().release_unused()

        yield from run(slices())
        pa.default_memory_pool().release_unused()

    return sliced


def text_parts(docs: DataFrame, broadcast_rows: int = 500_000) -> DataFrame | None:
    """(doc_id, h1, h2, part): numbers from 0 for the different texts of each doc_id that several rows have, in the order of two 64-bit hashes; None where no doc_id repeats, which the doc_ids alone tell. A null text counts as empty."""
    known = documents_of(docs).where("doc_id is not null")
    again = cut(known.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        discard(again)
        return None
    texts = known.join(small_side(again, broadcast_rows), "doc_id", "left_semi").select("doc_id", *_two_hashes()).distinct()
    order = Window.partitionBy("doc_id").orderBy("h1", "h2")
    return cut(texts.withColumn("part", (F.row_number().over(order) - 1).cast("long")), again)


def _two_hashes():
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def numbered(texts: DataFrame, parts: DataFrame | None, broadcast_rows: int = 500_000) -> DataFrame:
    """``texts`` (doc_id, text, …) with ``part``, which tells apart the different texts of one doc_id: 0 where there is one only."""
    if parts is None:
        return texts.withColumn("part", F.lit(0).cast("long"))
    hashed = texts.select("*", *_two_hashes())
    met = hashed.join(small_side(parts, broadcast_rows), ["doc_id", "h1", "h2"], "left")
    return met.select(*texts.columns, F.coalesce("part", F.lit(0).cast("long")).alias("part"))
