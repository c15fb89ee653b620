import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from textroute.operators import linear, monitoring
from textroute.schemas import LOG_SCHEMA
from textroute.session import materialize, work_path
from textroute.sources import files
from textroute.streaming import jobs


def shares(spark, d):
    return spark.createDataFrame(list(d.items()), "category string, share double")


def test_psi_cases(spark):
    even = shares(spark, {"x": 0.5, "y": 0.5})
    assert monitoring.psi(even, even).first()[0] < 1e-6
    assert monitoring.psi(even, shares(spark, {"x": 0.9, "y": 0.1})).first()[0] > 0.25
    one_sided = monitoring.psi(shares(spark, {"x": 1.0}), shares(spark, {"y": 1.0})).first()[0]
    import math
    assert one_sided == pytest.approx(2 * (1 - 1e-4) * math.log(1e4))


def test_drift_status_uses_the_rounded_index(spark):
    df = spark.createDataFrame([(0.09994,), (0.09996,), (0.24994,), (0.24996,)], "v double")
    assert [r[0] for r in df.select(monitoring.drift_status(F.col("v"))).collect()] == ["stable", "watch", "watch", "investigate"]


def log_frame(spark, rows):
    """`(seconds, endpoint, product, confidence, cost)` as a log."""
    full = [(float(t), e, p, c, c < 0.6, 2.0 + i, 100, True if e == "draft" else None, None, 5.0 if e == "draft" else None, cost)
            for i, (t, e, p, c, cost) in enumerate(rows)]
    df = spark.createDataFrame(full, LOG_SCHEMA)
    return df.withColumn("ts", files.from_epoch(F.col("ts")))


def test_report_on_three_rows(spark):
    log = log_frame(spark, [(1, "predict", "a", 0.9, None), (2, "predict", "b", 0.5, None), (3, "predict", "c", 0.7, None)])
    train = shares(spark, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})
    rep = monitoring.monitor_report(log, train).first()
    assert rep["n_requests"] == 3 and rep["drift_status"] == "stable" and rep["n_drafts"] is None
    assert rep["share_needs_review"] == pytest.approx(1 / 3)
    assert rep["latency_ms_p50"] == 3.0 and rep["latency_ms_p95"] == pytest.approx(3.9)


def test_empty_log(spark):
    log = files.scan_log(spark, work_path(spark, "no-log"))
    rep = monitoring.monitor_report(log, shares(spark, {"a": 1.0})).first()
    assert rep["n_requests"] == 0 and rep["drift_status"] is None


def test_log_round_trip_skips_blank_lines(spark, tmp_path):
    log = log_frame(spark, [(1700000000.123456, "predict", "a", 0.9, None), (1700000001.5, "draft", "b", 0.5, 0.25)])
    path = str(tmp_path / "log")
    files.append_log(log, path)
    (tmp_path / "log" / "x.json").write_text('\n{"ts": 1, "endpoint": "predict"}\n\n')
    rows = files.scan_log(spark, path).orderBy("ts").collect()
    assert [r["ts"] for r in rows] == [dt.datetime(1970, 1, 1, 0, 0, 1), dt.datetime(2023, 11, 14, 22, 13, 20, 123456),
                                       dt.datetime(2023, 11, 14, 22, 13, 21, 500000)]
    assert rows[0]["product"] is None and rows[2]["draft_cost_usd"] == 0.25


def test_recent_window_is_inclusive(spark):
    log = log_frame(spark, [(0, "predict", "a", 1.0, None), (3600, "predict", "a", 1.0, None), (7200, "predict", "a", 1.0, None)])
    assert monitoring.recent_window(log, 1).count() == 2
    assert monitoring.recent_window(log, 0).count() == monitoring.recent_window(log, None).count() == 3


def sequential(rows, cap):
    spent, out = {}, {}
    for i, t, cost in sorted(rows, key=lambda r: (r[1], r[0])):
        day = int(t // 86400)
        out[i] = spent.get(day, Decimal(0)) < Decimal(str(cap))
        if out[i]:
            spent[day] = spent.get(day, Decimal(0)) + Decimal(str(cost))
    return out


def budget_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.choice([86400 * rng.randint(0, 3) + rng.randint(0, 50), 86400 + 10, 86400 + 10 + rng.randint(0, 3) / 1e6])
        rows.append((i, t, rng.choice([0.0, 0.002, 0.0005, 0.01])))
    return rows


def budget_log(spark, rows):
    df = spark.createDataFrame([(i, float(t), "draft", cost) for i, t, cost in rows], "event_id long, ts double, endpoint string, draft_cost_usd double")
    return df.withColumn("ts", files.from_epoch(F.col("ts")))


@pytest.mark.parametrize("seed, cap", [(1, 0.5), (2, 0.05), (3, 0.002), (4, 0.0), (5, 100.0)])
def test_admission_equals_the_sequential_rule(spark, seed, cap):
    rows = budget_rows(seed)
    got = {r["event_id"]: r["admitted"] for r in monitoring.budget_admission(budget_log(spark, rows), cap).collect()}
    assert got == sequential(rows, cap)


def test_first_draft_passes_second_is_rejected(spark):
    log = budget_log(spark, [(1, 10, 0.0018), (2, 20, 0.0018)])
    out = monitoring.budget_admission(log, 0.001)
    assert [r["admitted"] for r in out.orderBy("event_id").collect()] == [True, False]
    spend = monitoring.daily_spend(out).first()
    assert spend["n_admitted"] == 1 and spend["spend_usd"] == pytest.approx(0.0018)


def test_budget_stream_carries_spend_between_batches(spark, tmp_path):
    rows = sorted(budget_rows(7), key=lambda r: (r[1], r[0]))
    folder = str(tmp_path / "log")
    third = len(rows) // 3
    out, mark = (work_path(spark, n) for n in ("admitted", "mark"))
    # Three arrivals in time order; cut between time stamps, so that no tie is split.
    cuts = [0]
    for c in (third, 2 * third):
        while rows[c][1] == rows[c - 1][1]:
            c += 1
        cuts.append(c)
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        part = budget_log(spark, rows[a:b])
        files.log_rows(part, "event_id").coalesce(1).write.mode("append").json(folder)
        jobs.budget_stream(jobs.stream_log(spark, folder, "event_id long"), out, mark, 0.05)
    got = {r["event_id"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    assert got == sequential(rows, 0.05)
    # Nothing new arrives: nothing changes.
    jobs.budget_stream(jobs.stream_log(spark, folder, "event_id long"), out, mark, 0.05)
    assert spark.read.parquet(out).count() == len(rows)


def test_ingest_stream_forgets_no_id(spark, tmp_path):
    from tests.test_prep import FAULTS, raw_rows
    from textroute.operators import cleaning
    from textroute.schemas import RAW_SCHEMA
    raw = spark.createDataFrame(raw_rows(200), RAW_SCHEMA)
    folder, out, mark = str(tmp_path / "raw"), work_path(spark, "clean"), work_path(spark, "mark")
    options = dict(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    for _ in range(2):
        raw.coalesce(1).write.mode("append").options(**options).csv(folder)
        jobs.run_available(jobs.ingest(jobs.stream_csv(spark, folder)), out, mark)
    got, want = spark.read.parquet(out), cleaning.clean(raw)
    assert got.count() == want.count() == 200 - FAULTS and got.select(want.columns).exceptAll(want).count() == 0
    bounded = jobs.ingest(jobs.stream_csv(spark, folder), "30 days")
    path = jobs.run_available(bounded, work_path(spark, "clean"), work_path(spark, "mark"))
    assert spark.read.parquet(path).count() == 200 - FAULTS


def test_windows_equal_the_batch_and_drop_late_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.uniform(0, 86400), "predict", rng.choice("abc"), round(rng.random(), 2), None) for _ in range(500)]
    folder = str(tmp_path / "log")
    files.append_log(log_frame(spark, rows).coalesce(1), folder)
    stats, counts, m1, m2 = (work_path(spark, n) for n in ("stats", "counts", "m1", "m2"))

    def run():
        log = jobs.stream_log(spark, folder)
        jobs.run_available(jobs.window_stats(log, "1 hour", lateness="10 minutes"), stats, m1)
        jobs.run_available(jobs.window_counts(log, "1 hour", lateness="10 minutes"), counts, m2)

    run()
    # A row far behind the watermark changes nothing.
    files.append_log(log_frame(spark, [(5.0, "predict", "a", 0.5, None)]), folder)
    run()
    train = shares(spark, {"a": 0.5, "b": 0.5})
    got = {r["window_start"]: r for r in jobs.window_report(spark.read.parquet(stats), spark.read.parquet(counts), train).collect()}
    latest = max(t for t, *_ in rows) - 600
    want = {}
    for t, _, p, c, _ in rows:
        want.setdefault(int(t // 3600), []).append((p, c))
    closed = {h: v for h, v in want.items() if (h + 1) * 3600 <= latest}
    assert {(k - dt.datetime(1970, 1, 1)).total_seconds() // 3600 for k in got} == set(closed)
    for h, v in closed.items():
        r = got[dt.datetime(1970, 1, 1) + dt.timedelta(hours=h)]
        assert r["n_requests"] == len(v)
        assert r["mean_confidence"] == pytest.approx(sum(c for _, c in v) / len(v))
        live = {p: sum(1 for x, _ in v if x == p) / len(v) for p, _ in v}
        frame = shares(spark, live)
        assert r["psi"] == pytest.approx(monitoring.psi(train, frame).first()[0])
        waits = sorted(2.0 + i for i, (t, *_) in enumerate(rows) if int(t // 3600) == h)
        assert r["latency_ms_p50"] == waits[(len(waits) - 1) // 2] and r["latency_ms_p95"] == waits[-(-len(waits) * 95 // 100) - 1]
        assert r["window_end"] - r["window_start"] == dt.timedelta(hours=1)


@pytest.mark.parametrize("blocks", [("word",), ("word", "char")])
def test_route_stream_equals_the_batch(spark, blocks):
    texts = {"Card": "the card company charged a late fee", "Loan": "the loan servicer lost my forms"}
    toy = materialize(spark.createDataFrame([(i * 2 + j, p, f"{t} number {i} call 410-555-1234", dt.datetime(2024, 1, 1))
                                             for i in range(20) for j, (p, t) in enumerate(texts.items())],
                                            "complaint_id long, product string, narrative string, ts timestamp_ntz"))
    model = linear.fit(toy, max_iter=30, blocks=blocks, max_features={b: 1000 for b in blocks})
    records = toy.select("complaint_id", "narrative", "ts").unionByName(spark.createDataFrame(
        [(90, None, dt.datetime(2024, 1, 2)), (91, "zzz", dt.datetime(2024, 1, 2)), (91, "", dt.datetime(2024, 1, 2))],
        "complaint_id long, narrative string, ts timestamp_ntz"))
    # Row by row as by the joins.
    by_rows = records.select("complaint_id", linear.row_logits(model)(F.col("narrative")).alias("z")).filter("complaint_id < 90")
    by_joins = {r.complaint_id: r.z for r in linear.logits(toy, model).collect()}
    assert all(r.z == pytest.approx(by_joins[r.complaint_id]) for r in by_rows.collect()) and len(by_joins) == 40
    source, out, mark = (work_path(spark, n) for n in ("records", "routed", "mark"))
    records.filter("complaint_id < 10").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(records.schema).parquet(source)
    plan = jobs.route_rows(records, model, "complaint_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # one plan without state
    jobs.route_stream(stream, model, out, mark, "complaint_id")
    records.filter("complaint_id >= 10").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new and adds nothing
        jobs.route_stream(stream, model, out, mark, "complaint_id")
    got = files.scan_log(spark, out, "complaint_id long")
    want = jobs.route_rows(records, model, "complaint_id")
    cols = ["complaint_id", "product", "confidence", "needs_review", "narrative_len", "endpoint"]
    assert got.count() == 43 and got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.filter("narrative_len < 100 or narrative_len is null").count() == 43
    assert {r["product"] for r in got.filter("complaint_id in (0, 1)").collect()} == {"Card", "Loan"}
    unknown = got.filter("complaint_id >= 90").select("product", "confidence").distinct().collect()
    assert len(unknown) == 1  # by the intercepts alone
