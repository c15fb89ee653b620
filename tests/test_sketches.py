"""Sketches stay within their stated error, whatever the order and number of merges."""
import random

from pyspark.sql import functions as F

from textroute.operators import sketches
from textroute.session import work_path

COLUMNS = "narrative string, company string, narrative_len int, day string"


def by_metric(frame):
    return {(r["column"], r["metric"]): r for r in frame.collect()}


def test_error_over_many_values_and_runs(spark):
    """300,000 rows, 200,000 texts, a third of all rows in one company, stored as nine runs of unequal size."""
    n, texts = 300_000, 200_000
    rows = spark.range(n).select(
        F.concat(F.lit("text "), F.col("id") % texts).alias("narrative"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise((F.col("id") % 70_000).cast("string")).alias("company"),
        (F.col("id") * 7919 % 100_003).cast("int").alias("narrative_len"), F.least(F.col("id") % 17, F.lit(8)).alias("day"))
    path = work_path(spark, "sketches")
    for day in range(9):
        sketches.store(sketches.sketch(rows.filter(F.col("day") == day)), path, str(day))
    got = by_metric(sketches.estimates(sketches.merge(sketches.load(spark, path))))
    exact = rows.agg(F.count_distinct("company")).first()[0]
    for column, want in (("narrative", texts), ("company", exact)):
        r = got[column, "distinct"]
        assert r["low"] <= want <= r["high"] and r["high"] - r["low"] <= 0.03 * want
    for q in (0.5, 0.95):
        r = got["narrative_len", f"q{q:g}"]
        rank = rows.filter(F.col("narrative_len") <= int(r["value"])).count() / n
        assert abs(rank - q) <= 2 * sketches.KLL_ERROR
        assert r["low"] <= q * 100_003 * 1.003 and r["high"] >= q * 100_003 * 0.997


def test_a_repeated_run_counts_once_and_merges_in_steps(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(str(rng.randrange(300)), rng.choice(["a", "b", None]), rng.randrange(90), str(i % 4))
                                  for i in range(900)], COLUMNS)
    path = work_path(spark, "sketches")
    for day in ("0", "1", "2", "3", "1"):
        sketches.store(sketches.sketch(rows.filter(F.col("day") == day)), path, day)
    stored = sketches.load(spark, path)
    whole = by_metric(sketches.estimates(sketches.merge(stored)))
    halves = sketches.merge(stored.filter("run < 2")).unionByName(sketches.merge(stored.filter("run >= 2")))
    assert sketches.merge(stored).first()["n_rows"] == 900
    stepwise = by_metric(sketches.estimates(sketches.merge(halves)))
    assert whole.keys() == stepwise.keys()
    assert whole["company", "distinct"]["value"] == stepwise["company", "distinct"]["value"] == 2
    # Fewer rows than the sketch keeps: quantiles are exact.
    lengths = sorted(r["narrative_len"] for r in rows.collect())
    assert whole["narrative_len", "q0.5"]["value"] == stepwise["narrative_len", "q0.5"]["value"] == lengths[449]


def test_keys_keep_their_own_sketches(spark):
    rows = spark.createDataFrame([("t1", "a", 5, "x"), ("t2", "a", 7, "x"), ("t1", "b", 9, "y"), (None, None, None, None)], COLUMNS)
    got = sketches.estimates(sketches.merge(sketches.sketch(rows, keys=("day",)), ("day",)), keys=("day",))
    found = {(r["day"], r["column"], r["metric"]): r["value"] for r in got.collect()}
    assert found["x", "narrative", "distinct"] == 2 and found["y", "narrative", "distinct"] == 1
    assert found["x", "narrative_len", "q0.95"] == 7 and found[None, "narrative", "distinct"] == 0
    assert found[None, "narrative_len", "q0.5"] is None


def test_empty_table(spark):
    rows = spark.createDataFrame([], COLUMNS)
    got = by_metric(sketches.estimates(sketches.merge(sketches.sketch(rows))))
    assert got["narrative", "distinct"]["value"] == 0 and got["narrative_len", "q0.5"]["value"] is None


def test_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([("t", "a", 5, "x")], COLUMNS).withColumns({"n_rows": F.lit(9), "hll_narrative": F.lit("z"), "run": F.lit(1)})
    assert sketches.sketch(rows).first()["n_rows"] == 1
