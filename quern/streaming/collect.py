"""Collection as a stream: each batch of observations is merged into a keyed index, which is replaced before the checkpoint
advances, so a replayed batch gives the same index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.collector import merged


def _path(spark: SparkSession, root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v{version:08d}"


def read_index(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest whole version (older than ``before``), or an empty index. A version is whole once its mark is written."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    whole = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    usable = [v for v in whole if before is None or v < before]
    schema = "key string, revision string, aliases array<string>"
    return spark.read.schema(schema).parquet(_path(spark, root, max(usable))) if usable else spark.createDataFrame([], schema)


def merge_batches(observations: DataFrame, root: str, checkpoint: str):
    """Start the stream (key, revision, alias, ts): of a key's observations in a batch the latest counts, with all aliases."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = batch.groupBy("key").agg(F.max_by("revision", F.struct("ts", "revision")).alias("revision"), F.array_sort(F.collect_set("alias")).alias("aliases"))
        merged(read_index(spark, root, number), found).drop("state").write.mode("overwrite").parquet(_path(spark, root, number))

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
