"""Late materialisation: the same rows as the plain form, and no text in what is ranked."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from textroute.operators import cleaning, late, splitting
from textroute.session import materialize

SCHEMA = "complaint_id long, date_received date, narrative string, product string, company string"


def exchanges(df):
    """What each exchange of the plan moves."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)


def random_rows(seed, n=600):
    """Few ids, dates and texts, so that every kind of tie occurs; nulls in every column."""
    rng = random.Random(seed)
    pick = lambda *values: rng.choice([*values, None])
    return [(pick(*range(120)), pick(*[dt.date(2020, 1, d) for d in (1, 2, 3)]), pick("a", "b", "", "a long text " * 50, "é"),
             pick("P", "Q"), pick("x", "y", "z")) for _ in range(n)]


def by_order(rows, key, columns):
    """The first row of each key, nulls first."""
    best = {}
    for row in rows:
        rank = [(row[c] is not None, row[c] if row[c] is not None else 0) for c in columns]
        if key(row) not in best or rank < best[key(row)][0]:
            best[key(row)] = (rank, row)
    return sorted((row for _, row in best.values()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_row_per_id_matches_brute_force_and_the_window(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = late.dedupe_ids(late.numbered(df))
    assert got.columns == df.columns
    want = by_order(rows, lambda r: r[0], [1, 2, 3, 4])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sorted(map(tuple, cleaning.dedupe_ids(df).collect()), key=repr) == want


def test_first_train_row_per_text(spark):
    rows = [(i, d, n, "P", s) for i, (_, d, n, _, s) in enumerate(random_rows(7)) if d and n is not None]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("split", F.when(F.col("company") == "z", "test").otherwise("train"))
    stored = late.located(materialize(df.repartition(4)))
    want = splitting.dedupe_train(df)
    got = late.dedupe_train(stored)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_same_row_twice_and_empty_table(spark):
    row = (1, dt.date(2020, 1, 1), "text", None, None)
    twice = late.numbered(spark.createDataFrame([row, row, row], SCHEMA))
    assert [tuple(r) for r in late.dedupe_ids(twice).collect()] == [row]
    assert late.dedupe_ids(late.numbered(spark.createDataFrame([], SCHEMA))).count() == 0


def test_locator_of_a_stored_table_is_unique(spark):
    stored = late.located(materialize(spark.range(1000).repartition(7)))
    assert stored.select(late.ROW).distinct().count() == 1000


def test_no_text_is_moved_to_rank_or_to_filter(spark):
    stored = late.numbered(spark.createDataFrame(random_rows(4), SCHEMA))
    order, wide = [F.col("date_received")], [F.col("narrative"), F.col("product")]
    narrow = late.narrow_rows(stored, F.col("complaint_id"), order, wide)
    moved = exchanges(late.repeated_keys(narrow))
    assert moved and not any("narrative" in columns or "product" in columns for columns in moved)
    assert exchanges(late.dedupe_ids(stored)) == []
    assert any("narrative" in columns for columns in exchanges(cleaning.dedupe_ids(stored.drop(late.ROW))))


def test_losers_beyond_the_limit_are_shuffled_by_locator(spark, monkeypatch):
    rows = random_rows(5)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(late, "broadcast_if_small", lambda frame: frame)
    got = late.dedupe_ids(late.numbered(df))
    assert sorted(map(tuple, got.collect()), key=repr) == by_order(rows, lambda r: r[0], [1, 2, 3, 4])


def test_a_hot_id_costs_one_row_per_task(spark):
    """A third of all rows share one id, one day and one text."""
    hot = F.col("id") % 3 == 0
    df = spark.range(6000, numPartitions=6).select(
        F.when(hot, -1).otherwise(F.col("id")).alias("complaint_id"), F.lit("2024-01-01").cast("date").alias("date_received"),
        F.when(hot, "hot").otherwise(F.col("id").cast("string")).alias("narrative"), F.lit("P").alias("product"), F.lit("c").alias("company"))
    stored = late.numbered(df)
    narrow = late.narrow_rows(stored, F.col("complaint_id"), [F.col("date_received")], [F.col("narrative")])
    plan = late.repeated_keys(narrow)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_min" in plan
    assert late.dedupe_ids(stored).count() == 4001
