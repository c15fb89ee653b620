"""Streams whose answers depend on state: the daily budget and the ids ingested so far."""
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tests.test_prep import raw_rows
from tests.test_traffic import budget_log, budget_rows, sequential
from textroute.operators import cleaning
from textroute.schemas import RAW_SCHEMA
from textroute.session import work_path
from textroute.sources import files
from textroute.streaming import jobs

DAY = 86_400


def feed(spark, folder, rows):
    files.log_rows(budget_log(spark, rows), "event_id").coalesce(1).write.mode("append").json(folder)


def run_budget(spark, folder, out, mark, cap):
    jobs.budget_stream(jobs.stream_log(spark, folder, "event_id long"), out, mark, cap)
    return {r.event_id: r.admitted for r in spark.read.parquet(out).collect()}


def kept_days(spark, mark, operator):
    state = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "spent").load(mark)
    return sorted({str(r.day) for r in state.select("key.day").collect()})


def test_a_busy_day_is_decided_over_several_batches(spark, tmp_path):
    """One day with nearly all requests, cut in mid-day and within one second, more requests than shards can let through."""
    rng = random.Random(11)
    rows = sorted(((i, DAY + i // 7, rng.choice([0.0, 0.001, 0.004])) for i in range(900)), key=lambda r: (r[1], r[0]))
    rows += [(2000 + i, 2 * DAY + i, 0.3) for i in range(3)]
    folder, out, mark = str(tmp_path / "log"), work_path(spark, "admitted"), work_path(spark, "mark")
    for a, b in ((0, 7), (7, 210), (210, 903)):
        feed(spark, folder, rows[a:b])
        got = run_budget(spark, folder, out, mark, 0.05)
        assert got == sequential(rows[:b], 0.05)
    assert spark.read.parquet(out).count() == len(rows)
    # A request that costs more than the cap is admitted if it comes first, and closes the day.
    feed(spark, folder, [(3000, 3 * DAY, 1e9), (3001, 3 * DAY + 1, 0.0)])
    got = run_budget(spark, folder, out, mark, 0.05)
    assert got[3000] and not got[3001]


def test_state_goes_with_its_day(spark, tmp_path):
    folder, out, mark = str(tmp_path / "log"), work_path(spark, "admitted"), work_path(spark, "mark")
    feed(spark, folder, [(1, 10, 0.01), (2, DAY + 10, 0.01)])
    run_budget(spark, folder, out, mark, 0.05)
    assert kept_days(spark, mark, 0) == kept_days(spark, mark, 1) == ["1970-01-01", "1970-01-02"]
    feed(spark, folder, [(3, 8 * DAY + 20, 0.01)])  # seven days past the end of the first day
    run_budget(spark, folder, out, mark, 0.05)
    feed(spark, folder, [(4, 8 * DAY + 30, 0.01)])
    got = run_budget(spark, folder, out, mark, 0.05)
    assert got == {1: True, 2: True, 3: True, 4: True}
    assert kept_days(spark, mark, 0) == kept_days(spark, mark, 1) == ["1970-01-02", "1970-01-09"]


def test_batches_spend_what_the_batch_operator_spends(spark, tmp_path):
    rows = sorted(budget_rows(3, 200), key=lambda r: (r[1], r[0]))
    folder, out, mark = str(tmp_path / "log"), work_path(spark, "admitted"), work_path(spark, "mark")
    feed(spark, folder, rows)
    got = run_budget(spark, folder, out, mark, 0.02)
    spent = {}
    for i, t, cost in rows:
        if got[i]:
            spent[int(t // DAY)] = spent.get(int(t // DAY), Decimal(0)) + Decimal(str(cost))
    assert got == sequential(rows, 0.02) and all(s >= Decimal("0.02") or d not in spent for d, s in spent.items() if not all(got[i] for i, t, _ in rows if int(t // DAY) == d))


def test_ingest_drops_nothing_when_the_newest_files_come_first(spark, tmp_path):
    raw = spark.createDataFrame(raw_rows(120), RAW_SCHEMA).withColumn("_n", F.monotonically_increasing_id())
    old = F.concat(F.lit("2011-0"), (1 + F.col("_n") % 9).cast("string"), F.lit("-15"))
    new = F.concat(F.lit("2026-0"), (1 + F.col("_n") % 9).cast("string"), F.lit("-15"))
    folder, out, mark = str(tmp_path / "raw"), work_path(spark, "clean"), work_path(spark, "mark")
    options = dict(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    half = F.col("_n") % 2 == 0
    for part in (raw.filter(half).withColumn("Date received", new), raw.filter(~half).withColumn("Date received", old), raw.withColumn("Date received", old)):
        part.drop("_n").coalesce(1).write.mode("append").options(**options).csv(folder)
        jobs.run_available(jobs.ingest(jobs.stream_csv(spark, folder)), out, mark)
    got = spark.read.parquet(out)
    want = cleaning.clean_rows(raw.withColumn("Date received", F.when(half, new).otherwise(old)).drop("_n"))
    assert got.count() == want.count() == got.select("complaint_id").distinct().count()
    assert got.select(want.columns).exceptAll(want).count() == 0
    assert "RocksDB" not in (spark.conf.get(jobs.STATE_STORE, None) or "")  # the session's own setting is as it was
