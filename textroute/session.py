"""Session settings and the few helpers that decide how data moves."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024


def build_session(app: str = "textroute", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as named by `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="textroute-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, grouped by application for easy removal."""
    return f"{shared_folder(spark)}/textroute-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> bool:
    """Remove this application's intermediate tables from the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/textroute-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage at a table that outlives executors, keeps column pruning and gives Catalyst
    a true size for later join decisions.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def serialized_bytes(df: DataFrame) -> int:
    """Size of the rows as JSON text, summed on the executors."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured size allows it.

    Above the limit the frame is returned as it is: the join then shuffles and adaptive execution
    splits skewed partitions. Call it on a materialized or stored table, since it reads it once.
    """
    return F.broadcast(df) if serialized_bytes(df) <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition raw rows by key before they are exploded.

    Aggregations on these keys plus anything else then need no further exchange, so only the
    unexpanded rows cross the network. The count is given so that small inputs that expand a lot
    are not coalesced into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def fill_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows by key when the scan yields fewer partitions than there are cores.

    Meant for a scan of a few files, or a projection of one, in front of costly expressions; a
    table of many files is returned as it is, without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return spread(df, *keys) if df.rdd.getNumPartitions() < cores else df
