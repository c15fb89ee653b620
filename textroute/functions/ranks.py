"""Exact order statistics without sorting the table or sending it to one task."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def _known(df: DataFrame, col: str) -> DataFrame:
    """The column's values as `v`, without nulls and NaN: the rows that every statistic here is about."""
    values = df.select(F.col(col).alias("v")).filter("v is not null")
    return values.filter(~F.isnan("v")) if _is_float(values) else values


def _is_float(values: DataFrame) -> bool:
    return values.schema["v"].dataType.simpleString() in ("double", "float")


def order_statistics(df: DataFrame, col: str, ranks: list[int]) -> dict[int, object]:
    """The values at the given 0-based positions of the sorted column (nulls and NaN left out).

    Infinite values are counted apart. Each pass counts the rows in at most `BINS` equal slices of every interval
    that still holds a wanted position and goes on inside the slice found, until that slice has a single
    value. An interval that slices no further, since its values are next to each other as doubles, is counted value
    by value. Only counters reach the driver; rows are pre-aggregated in the map tasks.
    """
    values = _known(df, col)
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    finite = (F.col("v") > low) & (F.col("v") < high) if _is_float(values) else F.lit(True)
    inner = F.when(finite, F.col("v"))
    whole = values.agg(F.count(inner).alias("n"), F.min(inner).alias("lo"), F.max(inner).alias("hi"),
                       F.count_if(~finite & (F.col("v") < 0)).alias("below"), F.count_if(~finite & (F.col("v") > 0)).alias("above")).first()
    return _ranked(values.filter(finite), whole, ranks)


def _ranked(values: DataFrame, whole, ranks: list[int]) -> dict[int, object]:
    below, n = whole["below"], whole["n"]
    found: dict[int, object] = {r: float("-inf") for r in ranks if 0 <= r < below}
    found |= {r: float("inf") for r in ranks if below + n <= r < below + n + whole["above"]}
    open_ranks = {r: (whole["lo"], whole["hi"], r - below) for r in ranks if below <= r < below + n}
    while open_ranks:
        for rank, (lo, hi, _) in list(open_ranks.items()):
            if lo == hi:
                found[rank] = lo
                del open_ranks[rank]
        intervals = sorted({(lo, hi) for lo, hi, _ in open_ranks.values()})
        if not intervals:
            break
        counters = _slice_counts(values, intervals)
        for rank, (lo, hi, offset) in list(open_ranks.items()):
            for n_rows, first, last in counters[(lo, hi)]:
                if offset < n_rows:
                    open_ranks[rank] = (first, last, offset)
                    break
                offset -= n_rows
    return found


def _slice_counts(values: DataFrame, intervals: list[tuple]) -> dict[tuple, list[tuple]]:
    """Rows, least and largest value of each slice that holds any. Halves are subtracted, so no range overflows."""
    kind = values.schema["v"].dataType
    which, part = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(intervals):
        inside = F.col("v").between(F.lit(lo).cast(kind), F.lit(hi).cast(kind))
        half = float(hi) / 2 - float(lo) / 2
        at = (F.col("v").cast("double") / 2 - float(lo) / 2) / (half or 1.0) * BINS
        which = F.when(inside, F.lit(i)).otherwise(which)
        part = F.when(inside, F.least(F.floor(at), F.lit(BINS - 1)).cast("int")).otherwise(part)
    rows = _counted(values.withColumn("which", which).withColumn("part", part), "part")
    out: dict[tuple, list[tuple]] = {interval: [] for interval in intervals}
    for r in rows:
        out[intervals[r["which"]]].append((r["n"], r["low"], r["high"]))
    stuck = [interval for interval, slices in out.items() if len(slices) == 1 and interval == slices[0][1:]]
    if stuck:
        which = F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(stuck):
            which = F.when(F.col("v").between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)), F.lit(i)).otherwise(which)
        out |= {interval: [] for interval in stuck}
        for r in _counted(values.withColumn("which", which), "v"):
            out[stuck[r["which"]]].append((r["n"], r["low"], r["high"]))
    return out


def _counted(rows: DataFrame, by: str) -> list:
    return (rows.filter("which is not null").groupBy("which", F.col(by).alias("at"))
                .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
                .orderBy("which", "at").collect())


def exact_percentiles(df: DataFrame, col: str, fractions: list[float]) -> list[float | None]:
    """Linearly interpolated percentiles, as `percentile` gives, for columns of any cardinality."""
    n = _known(df, col).count()
    if not n:
        return [None for _ in fractions]
    spots = [f * (n - 1) for f in fractions]
    wanted = sorted({r for s in spots for r in (int(s), min(int(s) + 1, n - 1))})
    at = order_statistics(df, col, wanted)
    out = []
    for s in spots:
        low, high = float(at[int(s)]), float(at[min(int(s) + 1, n - 1)])
        out.append(low if low == high or s == int(s) else low + (high - low) * (s - int(s)))
    return out
