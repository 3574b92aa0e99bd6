"""Session helpers: settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators need for right results or for skew handling. A cluster
# may override everything except the time zone and ANSI mode.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # With this on, a window, group and join over a union of two shuffles gave split
    # groups under adaptive execution (Spark 4.1.2); off, the same plan is right.
    "spark.sql.unionOutputPartitioning": "false",
}
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Session option: shuffle the rows of a text table over spark.sql.shuffle.partitions before work on them.
SPREAD = "spark.scholia.spread"
ROCKSDB_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "scholia", memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STORE)
        .config(SPREAD, "true")
    )
    for key, value in {**REQUIRED, **RECOMMENDED}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediates, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine may leave it unset; it then gets a temporary folder.
    On a cluster a folder of the driver's own is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; the files survive lost executors."""
    path = work_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_partitions(spark: SparkSession) -> int:
    """Partitions for text work: bound by CPU, not bytes, so it is not left to be coalesced by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan over the cores where the session asks for it (small tables in one file)."""
    if spark_option(df.sparkSession, SPREAD) == "true":
        return df.repartition(work_partitions(df.sparkSession), key)
    return df


def spark_option(spark: SparkSession, name: str) -> str:
    return spark.conf.get(name, "")
