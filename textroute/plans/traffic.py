"""Queries over the prediction log, in batch and as streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear, monitoring
from ..schemas import LOG_SCHEMA
from ..session import spread, work_path
from ..sources import files
from ..streaming import jobs
from .model import WORD_MODEL, _complaints, fixed_model
from .prep import clean_sql, raw_export
from .registry import query, rounded
from .replies import _LAST, _redaction_sql, folded
from .views import view, with_ctes

CAP = 0.5


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "log")


def _shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in cols})


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


_LIVE = {"live": """select product as category, count(*)::double / sum(count(*)) over () as share from log group by product"""}
_LATE = {"late": "select * from log where ts >= (select max(ts) from log) - interval 36 hour"}
_PSI = _LIVE | {"aligned": """select coalesce(e.category, a.category) as category, greatest(coalesce(e.share, 0), 0.0001::double) as e,
    greatest(coalesce(a.share, 0), 0.0001::double) as a from train_dist e full join live a using (category)"""}


@query("distribution", with_ctes(["log"], "select category, round(share, 6) as share from live", _LIVE))
def _(spark, sf_dir):
    return rounded(monitoring.distribution(_log(spark, sf_dir)), "share")


@query("psi", with_ctes(["log", "train_dist"], "select round(sum((a - e) * ln(a / e)), 9) as psi from aligned", _PSI))
def _(spark, sf_dir):
    return rounded(monitoring.psi(view(spark, sf_dir, "train_dist"), monitoring.distribution(_log(spark, sf_dir))), "psi", digits=9)


@query("drift_status", with_ctes(["log", "train_dist"], """
    select case when round_even(sum((a - e) * ln(a / e)), 4) < 0.1 then 'stable' when round_even(sum((a - e) * ln(a / e)), 4) < 0.25
    then 'watch' else 'investigate' end as drift_status, round(sum((a - e) * ln(a / e)), 6) as psi from aligned""", _PSI))
def _(spark, sf_dir):
    index = monitoring.psi(view(spark, sf_dir, "train_dist"), monitoring.distribution(_log(spark, sf_dir)))
    return index.select(monitoring.drift_status(F.col("psi")).alias("drift_status"), F.round("psi", 6).alias("psi"))


@query("recent_window", with_ctes(["log"], f"select event_id, {_ts('ts')} as ts from late", _LATE))
def _(spark, sf_dir):
    return _shown(monitoring.recent_window(_log(spark, sf_dir), 36).select("event_id", "ts"), "ts")


def _report_sql(source: str) -> str:
    return f"""
    select (select count(*) from {source}) as n_requests, (select {_ts('min(ts)')} from {source}) as first_ts,
        (select {_ts('max(ts)')} from {source}) as last_ts, (select round(avg(confidence), 6) from {source}) as mean_confidence,
        (select round(avg(needs_review::int), 6) from {source}) as share_needs_review,
        (select round(quantile_cont(latency_ms, 0.5), 6) from {source}) as latency_ms_p50,
        (select round(quantile_cont(latency_ms, 0.95), 6) from {source}) as latency_ms_p95,
        (select round(sum((a - e) * ln(a / e)), 6) from aligned) as psi_prediction_drift,
        (select string_agg(category || '=' || round(share, 6)::varchar, ';' order by category) from live) as live_distribution,
        (select case when round_even(sum((a - e) * ln(a / e)), 4) < 0.1 then 'stable'
            when round_even(sum((a - e) * ln(a / e)), 4) < 0.25 then 'watch' else 'investigate' end from aligned) as drift_status,
        (select count(*) from {source} where endpoint = 'draft') as n_drafts,
        (select round(avg(citation_ok::int), 6) from {source} where endpoint = 'draft') as citation_pass_rate,
        (select round(quantile_cont(draft_latency_ms, 0.5), 6) from {source} where endpoint = 'draft') as draft_latency_ms_p50,
        (select round(sum(draft_cost_usd), 6) from {source} where endpoint = 'draft') as draft_cost_usd_total"""


_DOUBLES = ["mean_confidence", "share_needs_review", "latency_ms_p50", "latency_ms_p95", "psi_prediction_drift",
            "citation_pass_rate", "draft_latency_ms_p50", "draft_cost_usd_total"]


def _report(log: DataFrame, train_dist: DataFrame, hours: int | None = None) -> DataFrame:
    row = monitoring.monitor_report(log, train_dist, hours)
    parts = F.transform(F.map_entries("live_distribution"), lambda x: F.concat(
        x["key"], F.lit("="), F.round(x["value"], 6).cast("string")))
    return _shown(rounded(row, *_DOUBLES).withColumn("live_distribution", F.array_join(parts, ";")), "first_ts", "last_ts")


@query("monitor_report", with_ctes(["log", "train_dist"], _report_sql("log"), _PSI))
def _(spark, sf_dir):
    return _report(_log(spark, sf_dir), view(spark, sf_dir, "train_dist"))


_RECENT = _LATE | {k: v.replace("from log", "from late") for k, v in _PSI.items()}


@query("monitor_report_recent", with_ctes(["log", "train_dist"], _report_sql("late"), _RECENT))
def _(spark, sf_dir):
    return _report(_log(spark, sf_dir), view(spark, sf_dir, "train_dist"), hours=36)


@query("draft_monitor", with_ctes(["log"], """
    select count(*) as n_drafts, round(avg(citation_ok::int), 6) as citation_pass_rate,
        round(quantile_cont(draft_latency_ms, 0.5), 6) as draft_latency_ms_p50, round(sum(draft_cost_usd), 6) as draft_cost_usd_total
    from log where endpoint = 'draft'"""))
def _(spark, sf_dir):
    return rounded(monitoring.draft_monitor(_log(spark, sf_dir)), "citation_pass_rate", "draft_latency_ms_p50", "draft_cost_usd_total")


ADMITTED = {
    "spent": """select *, ts::date as day, coalesce(sum(draft_cost_usd::decimal(28,12)) over (partition by ts::date order by ts, event_id
        rows between unbounded preceding and 1 preceding), 0) as before from log where endpoint = 'draft'""",
    "admitted": f"select *, before < {CAP}::decimal(28,12) as admitted from spent",
}
_ADMIT_SQL = with_ctes(["log"], "select event_id, day, admitted from admitted", ADMITTED)


@query("budget_admission", _ADMIT_SQL)
def _(spark, sf_dir):
    return monitoring.budget_admission(_log(spark, sf_dir), CAP).select("event_id", "day", "admitted")


@query("daily_spend", with_ctes(["log"], """
    select day, count(*) as n_admitted, round(sum(draft_cost_usd::decimal(28,12))::double, 6) as spend_usd
    from admitted where admitted group by day""", ADMITTED))
def _(spark, sf_dir):
    return rounded(monitoring.daily_spend(monitoring.budget_admission(_log(spark, sf_dir), CAP)), "spend_usd")


_LOG_COLS = LOG_SCHEMA.fieldNames()


@query("scan_log", with_ctes(["log"], "select " + ", ".join(
    f"{_ts('ts')} as ts" if c == "ts" else c for c in _LOG_COLS) + " from log"))
def _(spark, sf_dir):
    """Append the log in two parts and read it back."""
    path, log = work_path(spark, "log"), _log(spark, sf_dir)
    files.append_log(log.filter("endpoint = 'draft'"), path)
    files.append_log(log.filter("endpoint <> 'draft'"), path)
    return _shown(files.scan_log(spark, path), "ts")


# Streams. Each reads files written from the tables and is compared with the batch answer.

def _log_files(spark: SparkSession, sf_dir: str) -> str:
    """The log as JSON files in folders per day, cut by time so that no day is left to one task."""
    path = work_path(spark, "log-files")
    log = _log(spark, sf_dir)
    rows = files.log_rows(log.withColumn("day", F.to_date("ts")), "event_id", "day")
    rows.repartitionByRange("day", "ts").write.partitionBy("day").json(path)
    return path + "/*"


@query("stream_ingest", clean_sql("select complaint_id, count(*) as n from cleaned group by complaint_id"))
def _(spark, sf_dir):
    raw, out, mark = (work_path(spark, n) for n in ("raw-files", "ingested", "ingest-checkpoint"))
    (spread(raw_export(spark, sf_dir), "Complaint ID").write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(raw))
    jobs.run_available(jobs.ingest(jobs.stream_csv(spark, raw)), out, mark)
    return spark.read.parquet(out).groupBy("complaint_id").agg(F.count("*").alias("n"))


# Requests are folded on both sides, since the redaction rules meet them; the model is that of the whole texts.
_REDACTED = _redaction_sql("complaints", "complaint_id", "narrative")
_ROUTED = WORD_MODEL | _REDACTED | {
    "r_terms": rf"""select complaint_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term
        from (select complaint_id, regexp_extract_all(lower(txt), '[\p{{L}}\p{{N}}_]{{2,}}') as t from {_LAST})""",
    "r_weighted": """select complaint_id, term, (1 + ln(count(*)::double)) * any_value(idf) as weight
        from r_terms join word_idf using (term) group by complaint_id, term""",
    "r_values": "select complaint_id, term, weight / sqrt(sum(weight * weight) over (partition by complaint_id)) as value from r_weighted",
    "r_logits": f"""select c.complaint_id, k.class, any_value(k.b) + coalesce(sum(v.value * f.w), 0) as z
        from complaints c cross join classes k left join r_values v on v.complaint_id = c.complaint_id
        left join coef f on f.class = k.class and f.term = v.term group by c.complaint_id, k.class""",
    "r_proba": """select complaint_id, class, exp(z - m) / sum(exp(z - m)) over (partition by complaint_id) as p
        from (select *, max(z) over (partition by complaint_id) as m from r_logits)""",
    "r_best": """select complaint_id, max(class) filter (r = 1) as product, max(p) filter (r = 1) as p
        from (select *, row_number() over (partition by complaint_id order by round(p, 9) desc, class) as r from r_proba) group by complaint_id""",
}


@query("stream_route", with_ctes(["complaints"], f"""
    select complaint_id, product, round_even(p, 4) as confidence, p < 0.6 as needs_review, length(txt)::bigint as narrative_len,
           {_ts('date_received::timestamp')} as ts
    from r_best join {_LAST} using (complaint_id) join (select complaint_id, date_received from complaints) using (complaint_id)""", _ROUTED))
def _(spark, sf_dir):
    """The log lines of all records, redacted and scored as they arrive with the fixed model."""
    df = _complaints(spark, sf_dir)
    model = fixed_model(df)
    source, out, mark = (work_path(spark, n) for n in ("records", "routed", "route-checkpoint"))
    timed = df.select("complaint_id", folded(F.col("narrative")).alias("narrative"), F.col("date_received").cast("timestamp_ntz").alias("ts"))
    timed.write.parquet(source)
    jobs.route_stream(spark.readStream.schema(timed.schema).parquet(source), model, out, mark, "complaint_id")
    rows = files.scan_log(spark, out, "complaint_id long")
    return _shown(rows, "ts").select("complaint_id", "product", "confidence", "needs_review", "narrative_len", "ts")


_WINDOWS = {
    "kept": "select *, time_bucket(interval 6 hour, ts) as w from log",
    "closed": """select w, count(*) as n_requests, avg(confidence) as mean_confidence, avg(needs_review::int) as share_needs_review,
        quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95
        from kept where w + interval 6 hour <= (select max(ts) from log) - interval 1 hour group by w""",
    "pairs": """select w, p.category, greatest(coalesce(t.share, 0), 0.0001::double) as e,
        greatest(coalesce((select count(*) from kept k where k.w = c.w and k.product = p.category)::double / c.n_requests, 0), 0.0001::double) as a
        from closed c cross join (select category from train_dist union select product from log) p
        left join train_dist t on t.category = p.category""",
    "drift": "select w, sum((a - e) * ln(a / e)) as psi from pairs group by w",
}


@query("stream_monitor", with_ctes(["log", "train_dist"], f"""
    select {_ts('w')} as window_start, {_ts('w + interval 6 hour')} as window_end, n_requests, round(mean_confidence, 6) as mean_confidence,
        round(share_needs_review, 6) as share_needs_review, p50 as latency_ms_p50, p95 as latency_ms_p95, round(psi, 6) as psi,
        case when round_even(psi, 4) < 0.1 then 'stable' when round_even(psi, 4) < 0.25 then 'watch' else 'investigate' end as drift_status
    from closed join drift using (w)""", _WINDOWS))
def _(spark, sf_dir):
    source = _log_files(spark, sf_dir)
    out = {n: work_path(spark, n) for n in ("stats", "counts")}
    log = jobs.stream_log(spark, source)
    jobs.run_available(jobs.window_stats(log, "6 hours"), out["stats"], work_path(spark, "stats-checkpoint"))
    jobs.run_available(jobs.window_counts(log, "6 hours"), out["counts"], work_path(spark, "counts-checkpoint"))
    report = jobs.window_report(spark.read.parquet(out["stats"]), spark.read.parquet(out["counts"]),
                                view(spark, sf_dir, "train_dist"))
    return _shown(rounded(report, "mean_confidence", "share_needs_review", "psi"), "window_start", "window_end")


@query("stream_budget", _ADMIT_SQL)
def _(spark, sf_dir):
    source = _log_files(spark, sf_dir)
    out, mark = (work_path(spark, n) for n in ("admitted", "budget-checkpoint"))
    # One micro-batch, so that arrival order is time order; the tests feed several.
    log = jobs.stream_log(spark, source, "event_id long", max_files=1_000_000)
    jobs.budget_stream(log, out, mark, CAP)
    return spark.read.parquet(out).select("event_id", "day", "admitted")
