"""Drift, latency, review share and spend from the prediction log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_percentiles
from .profiling import shares

EPS = 1e-4
DAILY_CAP_USD = 0.50
MONEY = "decimal(28,12)"


def distribution(df: DataFrame, key: str = "product") -> DataFrame:
    """`(category, share)` of the rows that have a category."""
    known = df.filter(F.col(key).isNotNull())
    return shares(known, key).select(F.col(key).alias("category"), "share")


def psi(expected: DataFrame, actual: DataFrame, eps: float = EPS) -> DataFrame:
    """Population stability index of two `(category, share)` tables over the union of categories."""
    e = F.greatest(F.coalesce("expected", F.lit(0.0)), F.lit(eps))
    a = F.greatest(F.coalesce("actual", F.lit(0.0)), F.lit(eps))
    both = (expected.select("category", F.col("share").alias("expected"))
                    .join(actual.select("category", F.col("share").alias("actual")), "category", "full_outer"))
    return both.agg(F.coalesce(F.sum((a - e) * F.log(a / e)), F.lit(0.0)).alias("psi"))


def drift_status(value: Column) -> Column:
    """Judged on the index rounded to 4 digits, as it is reported."""
    shown = F.bround(value, 4)
    return F.when(shown < 0.1, "stable").when(shown < 0.25, "watch").otherwise("investigate")


def recent_window(log: DataFrame, hours: int | None) -> DataFrame:
    """Rows no older than `hours` before the latest one; 0 or None keeps all."""
    if not hours:
        return log
    latest = log.agg(F.max("ts")).scalar()
    return log.filter(F.col("ts") >= latest - F.make_dt_interval(hours=F.lit(hours)))


def traffic(log: DataFrame) -> DataFrame:
    """One row: requests, period, mean confidence, share for review, latency percentiles.

    The percentiles are exact and found by counting, since latencies have no small set of values.
    """
    p50, p95 = exact_percentiles(log, "latency_ms", [0.5, 0.95])
    return log.agg(F.count("*").alias("n_requests"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                   F.avg("confidence").alias("mean_confidence"),
                   F.avg(F.col("needs_review").cast("int")).alias("share_needs_review"),
                   F.lit(p50).cast("double").alias("latency_ms_p50"),
                   F.lit(p95).cast("double").alias("latency_ms_p95"))


def draft_monitor(log: DataFrame) -> DataFrame:
    drafts = log.filter("endpoint = 'draft'")
    p50, = exact_percentiles(drafts, "draft_latency_ms", [0.5])
    return drafts.agg(F.count("*").alias("n_drafts"),
                      F.avg(F.col("citation_ok").cast("int")).alias("citation_pass_rate"),
                      F.lit(p50).cast("double").alias("draft_latency_ms_p50"),
                      F.sum("draft_cost_usd").alias("draft_cost_usd_total"))


def monitor_report(log: DataFrame, train_dist: DataFrame, hours: int | None = None) -> DataFrame:
    """One row with traffic, drift and draft figures; draft figures are null without drafts.

    An empty log gives `n_requests` 0 and nulls.
    """
    recent = recent_window(log, hours)
    live = distribution(recent)
    row = (traffic(recent).withColumn("_d", draft_monitor(recent).select(F.struct("*")).scalar())
           .withColumn("psi", psi(train_dist, live).scalar())
           .withColumn("live_distribution", live.agg(
               F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "share"))))).scalar()))
    some = F.col("_d.n_drafts") > 0
    empty = F.col("n_requests") == 0
    return row.select(
        "n_requests", "first_ts", "last_ts", F.when(~empty, F.col("psi")).alias("psi_prediction_drift"),
        "mean_confidence", "share_needs_review", "latency_ms_p50", "latency_ms_p95", "live_distribution",
        *[F.when(some, F.col(f"_d.{c}")).alias(c) for c in
          ("n_drafts", "citation_pass_rate", "draft_latency_ms_p50", "draft_cost_usd_total")],
        F.when(~empty, drift_status(F.col("psi"))).alias("drift_status"))


def _with_money(log: DataFrame) -> DataFrame:
    """Draft requests with UTC day, second, microsecond and cost as an exact decimal.

    Decimals make the running sums independent of the order in which partial sums are combined.
    """
    return (log.filter("endpoint = 'draft'")
               .withColumn("_day", F.to_date("ts"))
               .withColumn("_second", F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))
               .withColumn("_micro", F.date_format("ts", "SSSSSS").cast("int"))
               .withColumn("_cost", F.coalesce(F.col("draft_cost_usd").cast(MONEY), F.lit(0).cast(MONEY))))


def _crossing(sums: DataFrame, slot: str, cap: Column) -> DataFrame:
    """Per day the slot in which the running spend reaches the cap, and the spend before it.

    `sums` holds one row per day and slot with `_sum`, on top of `_base` spent earlier that day.
    """
    running = Window.partitionBy("_day").orderBy(slot).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = (F.col("_base") + F.sum("_sum").over(running)).cast(MONEY)
    return (sums.withColumn("_upto", upto).withColumn("_before", (F.col("_upto") - F.col("_sum")).cast(MONEY))
                .filter((F.col("_before") < cap) & (F.col("_upto") >= cap))
                .select("_day", F.col(slot).alias("_cut"), "_before"))


def budget_admission(log: DataFrame, cap: float = DAILY_CAP_USD, tie: str = "event_id",
                     spent: DataFrame | None = None) -> DataFrame:
    """Draft requests with `admitted`: whether less than `cap` had been spent that UTC day before.

    Costs are not negative, so admission per day is a prefix of the day in time order. Its end is
    found from sums per second, then per microsecond of that second; only the requests of that one
    microsecond are put in order by `tie`. A busy day is thus summed by all tasks. `spent` holds
    `(day, spend_usd)` from earlier runs, one row per calendar day.
    """
    limit, zero = F.lit(str(cap)).cast(MONEY), F.lit(0).cast(MONEY)
    rows = _with_money(log)
    if spent is None:
        rows = rows.withColumn("_base", zero)
    else:
        earlier = spent.select(F.col("day").alias("_day"), F.col("spend_usd").cast(MONEY).alias("_spent"))
        rows = (rows.join(F.broadcast(earlier), "_day", "left")
                    .withColumn("_base", F.coalesce("_spent", zero)).drop("_spent"))
    seconds = rows.groupBy("_day", "_second", "_base").agg(F.sum("_cost").alias("_sum"))
    # One row per calendar day: safe to broadcast.
    cut_second = F.broadcast(_crossing(seconds, "_second", limit)
                             .withColumnsRenamed({"_cut": "_cut_second", "_before": "_start"}))
    marked = rows.join(cut_second, "_day", "left")
    micros = (marked.filter("_second = _cut_second").groupBy("_day", "_micro", F.col("_start").alias("_base"))
                    .agg(F.sum("_cost").alias("_sum")))
    cut_micro = F.broadcast(_crossing(micros, "_micro", limit)
                            .withColumnsRenamed({"_cut": "_cut_micro", "_before": "_spent"}))
    marked = marked.join(cut_micro, "_day", "left")
    here = F.struct("_second", "_micro")
    cut = F.struct(F.col("_cut_second").alias("_second"), F.col("_cut_micro").alias("_micro"))
    open_day, no_cut = F.col("_base") < limit, F.col("_cut_second").isNull()
    at_cut = ~no_cut & (here == cut)
    clear = marked.filter(~at_cut).withColumn("admitted", open_day & (no_cut | (here < cut)))
    before = Window.partitionBy("_day").orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("_spent") + F.coalesce(F.sum("_cost").over(before), zero)
    tied = marked.filter(at_cut).withColumn("admitted", so_far < limit)
    return clear.unionByName(tied).select(*log.columns, F.col("_day").alias("day"), "admitted")


def daily_spend(admissions: DataFrame) -> DataFrame:
    """Admitted requests and their cost per UTC day."""
    return admissions.filter("admitted").groupBy("day").agg(
        F.count("*").alias("n_admitted"),
        F.sum(F.col("draft_cost_usd").cast(MONEY)).cast("double").alias("spend_usd"))
