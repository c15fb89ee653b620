"""The incremental jobs: ingest, routing, monitoring and budget as Structured Streaming.

Every job reads whatever has arrived (`availableNow`) and stops, so it can run on a schedule;
progress is in its checkpoint folder. Sinks written per micro-batch use one folder per batch id
and overwrite it, so a batch that is repeated after a failure leaves the same result.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import monitoring
from ..operators.cleaning import clean_rows
from ..operators.guardrails import redacted
from ..operators.linear import LinearModel, route, row_logits, softmax
from ..schemas import LOG_SCHEMA, RAW_SCHEMA
from ..sources.files import from_epoch, log_rows, utc_clock, utc_instant
from . import budget


def stream_csv(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RAW_SCHEMA).options(
        header=True, multiLine=True, quote='"', escape='"', maxFilesPerTrigger=1000).csv(folder)


def stream_log(spark: SparkSession, folder: str, extra: str | None = None, max_files: int = 1000) -> DataFrame:
    """The log as it grows; `extra` declares further fields the writer adds."""
    schema = T.StructType([*LOG_SCHEMA.fields, *(T.StructType.fromDDL(extra).fields if extra else [])])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)
    return rows.withColumn("ts", from_epoch(F.col("ts")))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Within the block, streams start with their state in RocksDB: on local disk, with what changed in the checkpoint folder.

    The state's size is then no matter of memory. A stream keeps the store it was first started with.
    """
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> str:
    """Process what has arrived into a folder of files, each row once: the sink's log names the files that count."""
    with state_on_disk(stream.sparkSession):
        (stream.writeStream.outputMode(mode).format(fmt).option("path", out)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return out


def ingest(raw: DataFrame, lateness: str | None = None) -> DataFrame:
    """Clean rows, one per id: the first that arrives.

    Every id ever seen stays in the state store, which `run_available` keeps on disk, so no row is lost in whatever order
    the files come. With `lateness`, an id is forgotten once its received date is that far behind the newest, and rows
    that arrive later than that are dropped: for a feed that never looks back.
    """
    rows = clean_rows(raw)
    if lateness is None:
        return rows.dropDuplicates(["complaint_id"])
    timed = rows.withColumn("_ts", F.col("date_received").cast("timestamp")).withWatermark("_ts", lateness)
    return timed.dropDuplicatesWithinWatermark(["complaint_id"]).drop("_ts")


def route_rows(records: DataFrame, model: LinearModel, *extra: str) -> DataFrame:
    """Log rows of `(ts, narrative)`: each request is redacted, scored and routed within its row, in a batch or a stream.

    `extra` names further columns of the records to keep.
    """
    clean = records.select(*extra, "ts", redacted(F.col("narrative")).alias("narrative"))
    kept = [*extra, "ts", "narrative_len"]
    scored = clean.withColumn("narrative_len", F.length("narrative").cast("long")).withColumn("z", row_logits(model)(F.col("narrative")))
    request = scored.select(F.struct(*kept).alias("request"), softmax("z").alias("p"))
    routed = route(request, model.classes, id_col="request")
    return routed.select("request.*", "product", "confidence", "top3", "needs_review", F.lit("predict").alias("endpoint"))


def route_stream(records: DataFrame, model: LinearModel, out: str, checkpoint: str, *extra: str) -> str:
    """Append one JSON line per record, each once: one streaming plan without state, ending in a file sink."""
    return run_available(log_rows(route_rows(records, model, *extra), *extra), out, checkpoint, fmt="json")


def window_stats(log: DataFrame, width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Requests, confidence, review share and latency per event-time window.

    Rows later than `lateness` are dropped; a window is emitted once it can no longer change.
    Sketches merge across tasks, so a busy window is no burden to one of them.
    """
    window = F.window("_at", width, slide) if slide else F.window("_at", width)
    q = F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95)), 10000)
    return (log.withColumn("_at", utc_instant(F.col("ts"))).withWatermark("_at", lateness).groupBy(window.alias("w"))
               .agg(F.count("*").alias("n_requests"), F.avg("confidence").alias("mean_confidence"),
                    F.avg(F.col("needs_review").cast("int")).alias("share_needs_review"), q.alias("q"))
               .select(utc_clock(F.col("w.start")).alias("window_start"), utc_clock(F.col("w.end")).alias("window_end"),
                       "n_requests", "mean_confidence", "share_needs_review", F.col("q")[0].alias("latency_ms_p50"),
                       F.col("q")[1].alias("latency_ms_p95")))


def window_counts(log: DataFrame, width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Requests per event-time window and product."""
    window = F.window("_at", width, slide) if slide else F.window("_at", width)
    return (log.withColumn("_at", utc_instant(F.col("ts"))).withWatermark("_at", lateness)
               .groupBy(window.alias("w"), "product").agg(F.count("*").alias("n"))
               .select(utc_clock(F.col("w.start")).alias("window_start"), "product", "n"))


def _psi_of(expected: Column, live: Column, eps: float) -> Column:
    """PSI of a map of live shares against an array of `(category, share)`, within the row."""
    def term(a: Column, e: Column) -> Column:
        return (a - e) * F.log(a / e)

    floor = F.lit(eps)
    listed = F.transform(expected, lambda x: term(
        F.greatest(F.coalesce(F.try_element_at(live, x["category"]), F.lit(0.0)), floor),
        F.greatest(x["share"], floor)))
    known = F.transform(expected, lambda x: x["category"])
    others = F.transform(F.filter(F.map_entries(live), lambda x: ~F.array_contains(known, x["key"])),
                         lambda x: term(F.greatest(x["value"], floor), floor))
    return F.aggregate(F.concat(listed, others), F.lit(0.0), lambda acc, x: acc + x)


def window_report(stats: DataFrame, counts: DataFrame, train_dist: DataFrame,
                  eps: float = monitoring.EPS) -> DataFrame:
    """The emitted windows with their drift against the training distribution."""
    expected = train_dist.agg(F.array_sort(F.collect_list(F.struct("category", "share")))).scalar()
    totals = counts.filter("product is not null").groupBy("window_start").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("product", "n")).alias("items"))
    shares = F.map_from_entries(F.transform("items", lambda x: F.struct(x["product"], x["n"] / F.col("total"))))
    drift = (totals.withColumn("live", shares).withColumn("expected", expected)
                   .select("window_start", _psi_of(F.col("expected"), F.col("live"), eps).alias("psi")))
    return (stats.join(drift, "window_start", "left")
                 .withColumn("drift_status", monitoring.drift_status(F.col("psi"))))


def budget_stream(log: DataFrame, out: str, checkpoint: str, cap: float = monitoring.DAILY_CAP_USD, tie: str = "event_id",
                  lateness: str = "7 days") -> str:
    """Admit or reject draft requests as they arrive, in time order within a micro-batch.

    What a day has spent is keyed state, so a run goes on where the last one stopped, also within a day; the sink holds each
    request once.
    """
    return run_available(budget.admissions(log, cap, tie, lateness), out, checkpoint)
