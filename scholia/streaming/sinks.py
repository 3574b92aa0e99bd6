"""Stream sinks: an append sink, and a latest-wins table in partitions by key hash."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators.writes import upsert_by_key
from scholia.session import ROCKSDB_STORE, cut_lineage, work_folder

#: Partitions of an upserted table.
BUCKETS = 16


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond memory; the arbitrary-state operators need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STORE)


def append_to_table(stream: DataFrame, path: str) -> None:
    """Drain the stream into Parquet files, exactly once per batch."""
    (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def upsert_writer(
    path: str, keys: Sequence[str], keep_if_null: Sequence[str] = (), buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: merge a batch into a Parquet table that is partitioned by key hash.

    Only the partitions that hold a key of the batch are read and written again. The merge is
    stored before it replaces them, and merging a batch twice gives the same table, so a
    batch that runs again after a failure leaves it right.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        touched = [r["_bucket"] for r in batch.select("_bucket").distinct().collect()]  # at most buckets
        base = _existing(spark, path)
        if not touched:
            return
        if base is not None:
            held = base.where(F.col("_bucket").isin(touched)).select(*batch.columns)
            batch = cut_lineage(upsert_by_key(held, batch, keys, keep_if_null))
        out = batch.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("_bucket").parquet(path)

    return write


def stream_upsert_sink(
    stream: DataFrame, path: str, keys: Sequence[str], keep_if_null: Sequence[str] = (), mode: str = "update"
) -> None:
    """Drain a stream whose batches hold each key once into a latest-wins table."""
    (
        stream.writeStream.outputMode(mode)
        .foreachBatch(upsert_writer(f"{path}/table", keys, keep_if_null))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table").drop("_bucket")
