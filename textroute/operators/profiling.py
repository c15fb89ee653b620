"""Profile of the clean table: class balance, lengths, gaps and volume over time."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shares(df: DataFrame, key: str, count: str = "n", share: str = "share") -> DataFrame:
    """Count and share of every value of `key`; the total is a scalar over the grouped rows."""
    counts = df.groupBy(key).agg(F.count("*").alias(count))
    return counts.withColumn(share, F.col(count) / counts.agg(F.sum(count)).scalar())


def class_balance(df: DataFrame, label: str = "product") -> DataFrame:
    return shares(df.filter(F.col(label).isNotNull()), label).orderBy(F.desc("n"), label)


def length_quantiles(df: DataFrame, col: str = "narrative_len") -> DataFrame:
    """Median and 95th percentile, interpolated and truncated.

    `percentile` merges one counter per distinct length, which the longest text bounds.
    """
    q = F.percentile(col, F.array(F.lit(0.5), F.lit(0.95)))
    return (df.agg(q.alias("q"))
              .select(F.col("q")[0].cast("int").alias("narrative_len_median"),
                      F.col("q")[1].cast("int").alias("narrative_len_p95")))


def duplicate_texts(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Rows whose text occurred before: all rows less the distinct texts, compared by digest."""
    digests = df.select(F.sha2(text, 256).alias("digest"))
    return digests.agg((F.count("*") - F.count_distinct("digest")).alias("duplicate_narratives"))


def summary_stats(df: DataFrame) -> DataFrame:
    """One row of headline numbers. Each distinct count is its own scalar, so no row is expanded."""
    balance = df.filter(F.col("product").isNotNull()).groupBy("product").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("n"), F.col("product"))
    classes = balance.agg(
        F.count("*").alias("n_classes"),
        F.max_by("product", F.struct(F.col("n"), F.col("product"))).alias("majority_class"),
        F.max("n").alias("majority_count"),
        F.min_by("product", rank).alias("minority_class"),
        F.min("n").alias("minority_count"),
    )
    one = classes.select(F.struct("*").alias("c"))
    base = df.agg(F.count("*").alias("rows"), F.min("date_received").alias("date_min"),
                  F.max("date_received").alias("date_max"))
    lengths = length_quantiles(df).select(F.struct("*").alias("q"))
    return (
        base.withColumn("c", one.scalar())
            .withColumn("q", lengths.scalar())
            .withColumn("duplicate_narratives", duplicate_texts(df).scalar())
            .withColumn("n_companies", df.agg(F.count_distinct("company")).scalar())
            .select("rows", "date_min", "date_max", "c.n_classes", "c.majority_class",
                    (F.col("c.majority_count") / F.col("rows")).alias("majority_share"),
                    "c.minority_class", "c.minority_count",
                    (F.col("c.majority_count") / F.col("c.minority_count")).alias("imbalance_ratio"),
                    "q.narrative_len_median", "q.narrative_len_p95",
                    "duplicate_narratives", "n_companies")
    )


def missing_pct(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column, from one aggregation."""
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "missing_pct")


def length_histogram(df: DataFrame, col: str = "narrative_len", clip: int = 5000, bins: int = 60) -> DataFrame:
    """Equal-width bins between the observed extremes; the last bin is closed on the right."""
    clipped = df.select(F.least(F.col(col), F.lit(clip)).cast("double").alias("v")).filter("v is not null")
    edges = clipped.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, hi = edges["lo"], edges["hi"]
    # A single observed value is given a range of one around it, as histogram tools do.
    left = F.when(lo == hi, lo - 0.5).otherwise(lo)
    width = F.when(lo == hi, F.lit(1.0)).otherwise(hi - lo) / bins
    counted = (clipped.groupBy("v").agg(F.count("*").alias("n"))
                      .withColumn("left", left).withColumn("width", width)
                      .withColumn("bin", F.least(F.floor((F.col("v") - F.col("left")) / F.col("width")),
                                                 F.lit(bins - 1)).cast("int")))
    found = counted.groupBy("bin").agg(F.sum("n").alias("n"))
    spine = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
               .withColumn("bin_left", left + F.col("bin") * width))
    return spine.join(found, "bin", "left").select("bin", "bin_left", F.coalesce("n", F.lit(0)).alias("n"))


def monthly_volume(df: DataFrame) -> DataFrame:
    """Rows per month, with zero for months without any between the first and the last."""
    counts = (df.groupBy(F.trunc("date_received", "month").alias("month"))
                .agg(F.count("*").alias("n")).filter("month is not null"))
    spine = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, key: str, k: int) -> DataFrame:
    """The `k` most frequent values of `key`, ties by value."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), key).limit(k).select(key))


def class_share_by_year(df: DataFrame, top_k: int = 6, label: str = "product") -> DataFrame:
    """Yearly share of the top classes among themselves; a class missing in a year has share 0."""
    top = top_values(df, label, top_k)
    # At most `top_k` rows: safe to send to every executor.
    counts = (df.join(F.broadcast(top), label, "left_semi")
                .groupBy(F.year("date_received").alias("year"), label).agg(F.count("*").alias("n")))
    years = counts.groupBy("year").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("n")))).alias("by_class"))
    classes = top.agg(F.array_sort(F.collect_list(label))).scalar()
    return (years.withColumn(label, F.explode(classes))
                 .select("year", label,
                         (F.coalesce(F.try_element_at("by_class", label), F.lit(0)) / F.col("total")).alias("share")))


def data_card(df: DataFrame) -> DataFrame:
    """Summary, class balance and missing shares as one long `(section, key, value)` table."""
    stats = summary_stats(df)
    texts = stats.select([F.col(c).cast("string").alias(c) for c in stats.columns])
    summary = texts.unpivot([], texts.columns, "key", "value").select(F.lit("summary").alias("section"), "key", "value")
    balance = class_balance(df)
    parts = [
        summary,
        balance.select(F.lit("class_count").alias("section"), F.col("product").alias("key"),
                       F.col("n").cast("string").alias("value")),
        balance.select(F.lit("class_share").alias("section"), F.col("product").alias("key"),
                       F.bround("share", 3).cast("string").alias("value")),
        missing_pct(df).select(F.lit("missing_pct").alias("section"), F.col("column").alias("key"),
                               F.bround("missing_pct", 1).cast("string").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)
