"""Files in and out: raw exports, clean tables, splits, logs, corpora, probabilities and reports."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CLEAN_SCHEMA, LOG_SCHEMA, RAW_SCHEMA


def scan_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with header and line breaks inside cells, every column a string.

    Fails when the header does not match. A multi-line file is read by one task, so give it a
    folder of many files and store the result as Parquet once.
    """
    return spark.read.schema(RAW_SCHEMA).options(
        header=True, multiLine=True, quote='"', escape='"', enforceSchema=False).csv(path)


def write_clean(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def load_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds as a UTC time stamp that does not depend on the session's time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=seconds.cast("decimal(18,6)"))


def to_epoch(ts: Column) -> Column:
    """UTC time stamp to epoch seconds."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    micros = F.date_format(ts, "SSSSSS").cast("double")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) + micros / 1e6


def utc_instant(ts: Column) -> Column:
    """A UTC time stamp as the instant it means, as event-time windows need it."""
    return F.timestamp_micros(F.round(to_epoch(ts) * 1e6).cast("long"))


def utc_clock(instant: Column) -> Column:
    """An instant as a UTC time stamp."""
    return from_epoch(F.unix_micros(instant) / 1e6)


def scan_log(spark: SparkSession, path: str, extra: str | None = None) -> DataFrame:
    """The prediction log, one JSON object per line; an empty table when there is none yet.

    `extra` declares further fields the writer adds.
    """
    schema = T.StructType([*LOG_SCHEMA.fields, *(T.StructType.fromDDL(extra).fields if extra else [])])
    try:
        rows = spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.select([from_epoch(F.col("ts")).alias("ts") if c == "ts" else F.col(c)
                        for c in schema.fieldNames()])


def log_rows(df: DataFrame, *extra: str) -> DataFrame:
    """The log's fields and any extra ones, with the time as epoch seconds; fields the rows lack stay out."""
    return df.select([to_epoch(F.col("ts")).alias("ts") if c == "ts" else F.col(c)
                      for c in [*LOG_SCHEMA.fieldNames(), *extra] if c in df.columns])


def append_log(df: DataFrame, path: str) -> str:
    log_rows(df).write.mode("append").json(path)
    return path


# Options of a write or read of many small files: on a local or mounted disk, no checksum file beside each and no process started to
# set each one's rights. Other stores don't read them.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def scan_corpus(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """`(source, raw)`: file name and whole text of every page."""
    pages = spark.read.option("pathGlobFilter", pattern).options(**PLAIN_LOCAL).text(folder, wholetext=True)
    return pages.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("raw"))


def write_splits(df: DataFrame, meta: DataFrame, path: str) -> str:
    """Rows partitioned by split, so that reading one split prunes the others, and the metadata as JSON."""
    df.write.mode("overwrite").partitionBy("split").option("compression", "zstd").parquet(f"{path}/rows")
    meta.write.mode("overwrite").json(f"{path}/meta")
    return path


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """Clean rows with their split; the declared schema also serves a split without rows."""
    return spark.read.schema(T.StructType([*CLEAN_SCHEMA.fields, T.StructField("split", T.StringType())])).parquet(f"{path}/rows")


def scan_proba(spark: SparkSession, path: str, id_col: str = "complaint_id") -> DataFrame:
    """`(id, class, p)` from a wide table with one probability column per class."""
    wide = spark.read.parquet(path)
    classes = [c for c in wide.columns if c != id_col]
    doubles = wide.select(id_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in classes])
    return doubles.unpivot([id_col], classes, "class", "p")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> str:
    """A result table as JSON lines or Parquet; the write decides nothing about the row count."""
    df.write.mode("overwrite").format(fmt).save(path)
    return path
