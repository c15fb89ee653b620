"""From raw export rows to the clean record table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import (CATEGORICALS, CLEAN_SCHEMA, CURRENT_LABELS, MIN_NARRATIVE_CHARS,
                       NULL_TOKENS, RENAMES)


def null_tokens(df: DataFrame) -> DataFrame:
    """Turn the texts that stand for a missing cell into nulls."""
    return df.select([F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c)
                      for c in df.columns])


def project_rename(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{raw}`").alias(name) for name, raw in RENAMES.items()])


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["narrative", "product", "complaint_id"])


def strip_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in ["narrative", *CATEGORICALS]})


def min_length(df: DataFrame, chars: int = MIN_NARRATIVE_CHARS) -> DataFrame:
    return df.filter(F.length("narrative") >= chars)


def tolerant_date(c: Column) -> Column:
    """A year-month-day text as a date; anything else, or outside 1677-09-22 to 2262-04-11, is null."""
    shaped = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c)
    day = F.try_to_date(shaped, "yyyy-M-d")
    return F.when(day.between(F.lit("1677-09-22").cast("date"), F.lit("2262-04-11").cast("date")), day)


def parse_dates(df: DataFrame) -> DataFrame:
    return (df.withColumn("date_received", tolerant_date(F.col("date_received")))
              .filter(F.col("date_received").isNotNull()))


def cast_ids(df: DataFrame) -> DataFrame:
    """Ids become whole numbers; a malformed one fails the job (ANSI cast)."""
    return df.withColumn("complaint_id", F.col("complaint_id").cast("long"))


def narrative_length(df: DataFrame) -> DataFrame:
    return df.withColumn("narrative_len", F.length("narrative").cast("int"))


def map_labels(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Replace superseded labels by exact match; other labels stay."""
    pairs = [F.lit(x) for kv in (CURRENT_LABELS if labels is None else labels).items() for x in kv]
    return df.withColumn("product", F.coalesce(F.try_element_at(F.create_map(*pairs), "product"), "product"))


def dedupe_ids(df: DataFrame, key: str = "complaint_id", order: list[str] | None = None) -> DataFrame:
    """One row per id: the earliest, ties broken by the remaining columns.

    `row_number = 1` is limited per map task before the exchange, so a repeated id costs at most
    one row per task however often it occurs.
    """
    order = order or ["date_received", "narrative",
                      *[c for c in df.columns if c not in (key, "date_received", "narrative")]]
    rank = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def row_cap(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Keep at most `max_rows` rows, the earliest by date and id: a switch for short trial runs."""
    if not max_rows:
        return df
    return df.orderBy("date_received", "complaint_id").limit(max_rows)


def clean_rows(raw: DataFrame) -> DataFrame:
    """Everything that concerns one row alone: no shuffle, usable on a batch or a stream."""
    df = drop_missing(project_rename(null_tokens(raw)))
    df = narrative_length(cast_ids(parse_dates(min_length(strip_text(df)))))
    return map_labels(df).select(CLEAN_SCHEMA.fieldNames())


def clean(raw: DataFrame, max_rows: int | None = None) -> DataFrame:
    return row_cap(dedupe_ids(clean_rows(raw)), max_rows)
