"""Landed files as streams: each processed once, the newest filing kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.external import exists
from ..sources.places import delete, new_place


def _source(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """``path`` is a folder or a pattern."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def ingest(spark: SparkSession, path: str, schema: StructType, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append what has landed in ``path`` since the last run with the same ``checkpoint`` to ``out``, and read ``out``."""
    out, checkpoint = out or new_place(spark, "stream"), checkpoint or new_place(spark, "stream")
    _source(spark, path, schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


class LatestState:
    """The newest row of each key, in ``buckets`` by the key's hash, as a folder of versions.

    A batch rewrites the buckets that it touches, as one version named by its number, and then commits: a small table
    (bucket, version) whose _SUCCESS mark is its last file. What no commit names is deleted, so the state holds one row
    a key. A batch that is there already changes nothing, and one that died half-way is written again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, order: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, list(order), buckets

    def _commits(self) -> list[int]:
        """The numbers of the committed batches, two at most are kept."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        names = [s.getPath().getName() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        return sorted(int(n) for n in names if exists(self.spark, f"{self.path}/commits/{n}/_SUCCESS"))

    def _versions(self, commit: int) -> dict[int, int]:
        return dict(self.spark.read.schema("bucket int, version long").json(f"{self.path}/commits/{commit}").collect())

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/data/version={version}/bucket={bucket}"

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c != self.key]
        # Rows of equal order are told apart by all their columns, so a batch gives the same state whenever it runs.
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order, F.to_json(F.struct(*rest)))).alias("row"))
        return newest.select(*(F.col(c) if c == self.key else F.col(f"row.`{c}`") for c in self.schema.names))

    def upsert(self, batch: DataFrame, number: int) -> None:
        done = self._commits()
        if done and number <= done[-1]:
            return
        versions = self._versions(done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        batch = batch.select(*self.schema.names).persist()
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
        if touched:
            old = [self._folder(b, versions[b]) for b in touched if b in versions]
            both = batch.union(self.spark.read.schema(self.schema).parquet(*old)) if old else batch
            self._newest(both).withColumn("bucket", bucket).repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number}")
        batch.unpersist()
        now = versions | {b: number for b in touched}
        table = self.spark.createDataFrame(sorted(now.items()), "bucket int, version long")
        table.coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{number}")
        # The commit before stays for readers that have begun; what only older ones name goes.
        replaced = [self._folder(b, v) for b, v in (self._versions(done[-2]).items() if len(done) > 1 else ()) if versions.get(b) != v]
        delete(self.spark, *replaced, *(f"{self.path}/commits/{n}" for n in done[:-1]))

    def read(self) -> DataFrame:
        done = self._commits()
        versions = self._versions(done[-1]) if done else {}
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(self._folder(b, v) for b, v in versions.items()))


def latest(spark: SparkSession, path: str, schema: StructType, key: str, order: Sequence[str], out: str | None = None, checkpoint: str | None = None, buckets: int = 64, files_per_batch: int | None = None) -> DataFrame:
    """The newest row of each key, by the ``order`` columns: what has landed since the last run with the same ``checkpoint`` is merged into the state in ``out``.

    The state is bounded by the keys. A row that arrives late replaces a key's row only if it is newer.
    """
    state = LatestState(spark, out or new_place(spark, "stream"), schema, key, order, buckets)
    options = {"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {}
    _source(spark, path, schema, **options).writeStream.foreachBatch(state.upsert).option("checkpointLocation", checkpoint or new_place(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return state.read()
