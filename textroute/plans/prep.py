"""Queries over cleaning, contract, profile and split."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, contract, late, profiling, sketches, splitting
from ..schemas import CATEGORICALS, CLEAN_SCHEMA, CURRENT_LABELS, NULL_TOKENS, RAW_HEADERS, RENAMES
from ..session import fill_cores, materialize, work_path
from ..sources import files
from .registry import joined, query, rounded
from .views import view, with_ctes

SPACE_SQL = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def _quoted(names: list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


_LABELS = " ".join(f"when '{old}' then '{new}'" for old, new in CURRENT_LABELS.items())
_CLEAN_COLS = CLEAN_SCHEMA.fieldNames()
_ORDER = ", ".join(f"{c} nulls first" for c in
                   ["date_received", "narrative", *[c for c in _CLEAN_COLS
                                                    if c not in ("complaint_id", "date_received", "narrative")]])

# The cleaning steps, one named query each.
STEPS = {
    "renamed": "select " + ", ".join(f"case when {c} in ({_quoted(NULL_TOKENS)}) then null else {c} end as {c}"
                                     for c in RENAMES) + " from raw_export",
    "present": "select * from renamed where narrative is not null and product is not null and complaint_id is not null",
    "stripped": "select * replace (" + ", ".join(f"{strip_sql(c)} as {c}" for c in ["narrative", *CATEGORICALS])
                + ") from present",
    "long_enough": "select * from stripped where length(narrative) >= 20",
    "dated": """select * from (select * replace (
                  case when regexp_matches(date_received, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$')
                       then try_strptime(date_received, '%Y-%m-%d')::date end as date_received) from long_enough)
                where date_received is not null""",
    "with_ids": "select * replace (complaint_id::bigint as complaint_id) from dated",
    "measured": "select *, length(narrative)::int as narrative_len from with_ids",
    "labelled": f"select * replace (case product {_LABELS} else product end as product) from measured",
    "cleaned": f"""select * exclude (r) from (select *, row_number() over (
                   partition by complaint_id order by {_ORDER}) r from labelled) where r = 1""",
}


def _upto(step: str) -> dict[str, str]:
    names = list(STEPS)
    return {n: STEPS[n] for n in names[:names.index(step) + 1]}


def clean_sql(body: str, step: str = "cleaned", extra: dict[str, str] | None = None) -> str:
    return with_ctes(["raw_export"], body, _upto(step) | (extra or {}))


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_cores(view(spark, sf_dir, "raw_export").toDF(*RAW_HEADERS), "Complaint ID")


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_missing(cleaning.project_rename(cleaning.null_tokens(raw_export(spark, sf_dir))))


@query("project_rename", clean_sql("select * from renamed", "renamed"))
def _(spark, sf_dir):
    return cleaning.project_rename(cleaning.null_tokens(raw_export(spark, sf_dir)))


@query("drop_missing", clean_sql("select * from present", "present"))
def _(spark, sf_dir):
    return _present(spark, sf_dir)


@query("strip_text", clean_sql("select * from stripped", "stripped"))
def _(spark, sf_dir):
    return cleaning.strip_text(_present(spark, sf_dir))


@query("min_length", clean_sql("select * from long_enough", "long_enough"))
def _(spark, sf_dir):
    return cleaning.min_length(cleaning.strip_text(_present(spark, sf_dir)))


@query("parse_dates", clean_sql("select complaint_id, date_received from dated", "dated"))
def _(spark, sf_dir):
    rows = cleaning.min_length(cleaning.strip_text(_present(spark, sf_dir)))
    return cleaning.parse_dates(rows).select("complaint_id", "date_received")


@query("cast_ids", clean_sql("select complaint_id, date_received, company from with_ids", "with_ids"))
def _(spark, sf_dir):
    rows = cleaning.parse_dates(cleaning.min_length(cleaning.strip_text(_present(spark, sf_dir))))
    return cleaning.cast_ids(rows).select("complaint_id", "date_received", "company")


@query("narrative_length", with_ctes(["complaints"], "select complaint_id, length(narrative)::int as narrative_len from complaints"))
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "complaints").drop("narrative_len")
    return cleaning.narrative_length(rows).select("complaint_id", "narrative_len")


@query("map_labels", clean_sql("select complaint_id, product, narrative_len from labelled", "labelled"))
def _(spark, sf_dir):
    return cleaning.clean_rows(raw_export(spark, sf_dir)).select("complaint_id", "product", "narrative_len")


@query("dedupe_ids", clean_sql(f"select {', '.join(_CLEAN_COLS)} from cleaned"))
def _(spark, sf_dir):
    return cleaning.clean(raw_export(spark, sf_dir))


@query("dedupe_ids_late", clean_sql(f"select {', '.join(_CLEAN_COLS)} from cleaned"))
def _(spark, sf_dir):
    return late.dedupe_ids(late.numbered(cleaning.clean_rows(raw_export(spark, sf_dir))))


@query("row_cap", clean_sql("select complaint_id, date_received from cleaned order by date_received, complaint_id limit 150"))
def _(spark, sf_dir):
    return cleaning.clean(raw_export(spark, sf_dir), max_rows=150).select("complaint_id", "date_received")


def _failure_rows() -> str:
    rules = {f"missing_column:{c}": "max(0)" for c in _CLEAN_COLS} | {"unexpected_columns": "max(0)"}
    for field in CLEAN_SCHEMA.fields:
        rules[f"type:{field.name}"] = "max(0)"
        if not field.nullable:
            rules[f"not_null:{field.name}"] = f"count(*) filter ({field.name} is null)"
    rules["unique:complaint_id"] = "count(complaint_id) - count(distinct complaint_id)"
    rules["date_not_before_start"] = "count(*) filter (date_received < date '2011-01-01')"
    rules["narrative_min_length"] = "count(*) filter (length(narrative) < 20)"
    rules["narrative_len_min"] = "count(*) filter (narrative_len < 20)"
    return " union all ".join(f"select '{rule}' as rule, ({expr})::bigint as n_failed from checked"
                              for rule, expr in rules.items())


_CHECKED = """select complaint_id - complaint_id % 2 as complaint_id,
    case when complaint_id % 5 = 0 then date '2010-06-01' else date_received end as date_received,
    * exclude (complaint_id, date_received) from complaints"""


_FAILURES_SQL = with_ctes(["complaints"], _failure_rows(), {"checked": _CHECKED})


def faulty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "complaints")
    return rows.withColumns({
        "complaint_id": F.col("complaint_id") - F.col("complaint_id") % 2,
        "date_received": F.when(F.col("complaint_id") % 5 == 0, F.lit("2010-06-01").cast("date"))
                          .otherwise(F.col("date_received"))})


@query("contract_failures", _FAILURES_SQL)
def _(spark, sf_dir):
    return contract.contract_failures(faulty_rows(spark, sf_dir))


@query("contract_failures_on_write", _FAILURES_SQL)
def _(spark, sf_dir):
    counts = contract.write_counted(faulty_rows(spark, sf_dir), work_path(spark, "checked"))
    return spark.createDataFrame(list(counts.items()), "rule string, n_failed long")


@query("validate_clean", clean_sql("select count(*) as n, sum(narrative_len)::bigint as chars from cleaned"))
def _(spark, sf_dir):
    stored = materialize(cleaning.clean(raw_export(spark, sf_dir)), "clean")
    return contract.validate(stored).agg(F.count("*").alias("n"), F.sum("narrative_len").alias("chars"))


# Sources and sinks of the clean table.

@query("scan_raw_csv", with_ctes(["raw_export"], "select complaint_id, date_received, narrative, company, state, product from raw_export"))
def _(spark, sf_dir):
    path = work_path(spark, "raw-csv")
    raw_export(spark, sf_dir).write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                            ignoreTrailingWhiteSpace=False).csv(path)
    rows = files.scan_raw_csv(spark, path)
    wanted = ["complaint_id", "date_received", "narrative", "company", "state", "product"]
    return rows.select([F.col(f"`{RENAMES[c]}`").alias(c) for c in wanted])


@query("write_clean", clean_sql(f"select {', '.join(_CLEAN_COLS)} from cleaned"))
def _(spark, sf_dir):
    path = work_path(spark, "clean")
    return files.load_clean(spark, files.write_clean(cleaning.clean(raw_export(spark, sf_dir)), path))


@query("load_clean", with_ctes(["complaints"], """
    select complaint_id, date_received, product, narrative, company, submitted_via, timely_response, narrative_len from complaints"""))
def _(spark, sf_dir):
    path = files.write_clean(view(spark, sf_dir, "complaints"), work_path(spark, "clean"))
    return files.load_clean(spark, path).select("complaint_id", "date_received", "product", "narrative", "company", "submitted_via",
                                                "timely_response", "narrative_len")


# Profile.

_BALANCE = "select product, count(*) as n, count(*)::double / sum(count(*)) over () as share from complaints group by product"


@query("class_balance", with_ctes(["complaints"], "select product, n, round(share, 6) as share from b", {"b": _BALANCE}))
def _(spark, sf_dir):
    return rounded(profiling.class_balance(view(spark, sf_dir, "complaints")), "share")


_SUMMARY = """
    select (select count(*) from complaints) as rows, (select min(date_received) from complaints) as date_min,
           (select max(date_received) from complaints) as date_max, (select count(*) from b) as n_classes,
           (select product from b order by n desc, product desc limit 1) as majority_class,
           round((select max(n) from b)::double / (select count(*) from complaints), 6) as majority_share,
           (select product from b order by n, product limit 1) as minority_class,
           (select min(n) from b) as minority_count,
           round((select max(n) from b)::double / (select min(n) from b), 6) as imbalance_ratio,
           (select trunc(quantile_cont(narrative_len, 0.5))::int from complaints) as narrative_len_median,
           (select trunc(quantile_cont(narrative_len, 0.95))::int from complaints) as narrative_len_p95,
           (select count(*) - count(distinct narrative) from complaints) as duplicate_narratives,
           (select count(distinct company) from complaints) as n_companies"""


@query("summary_stats", with_ctes(["complaints"], _SUMMARY, {"b": _BALANCE}))
def _(spark, sf_dir):
    return rounded(profiling.summary_stats(view(spark, sf_dir, "complaints")), "majority_share", "imbalance_ratio")


@query("length_quantiles", with_ctes(["complaints"], """
    select trunc(quantile_cont(narrative_len, 0.5))::int as narrative_len_median,
           trunc(quantile_cont(narrative_len, 0.95))::int as narrative_len_p95 from complaints"""))
def _(spark, sf_dir):
    return profiling.length_quantiles(view(spark, sf_dir, "complaints"))


def _exact_quantile(q: float) -> str:
    return f"""select 'narrative_len' as "column", 'q{q:g}' as metric, min(narrative_len)::double as exact, true as within_bounds
        from (select narrative_len, cume_dist() over (order by narrative_len) as c from complaints) where c >= {q}"""


@query("profile_sketches", with_ctes(["complaints"], """
    select 'narrative' as "column", 'distinct' as metric, count(distinct narrative)::double as exact, true as within_bounds from complaints
    union all select 'company', 'distinct', count(distinct company)::double, true from complaints
    union all """ + _exact_quantile(0.5) + " union all " + _exact_quantile(0.95)))
def _(spark, sf_dir):
    """Each channel is a run of its own; the merged sketches are held against the exact figures."""
    rows, path = view(spark, sf_dir, "complaints"), work_path(spark, "sketches")
    for r in rows.select("submitted_via").distinct().collect():
        sketches.store(sketches.sketch(rows.filter(F.col("submitted_via") == r["submitted_via"])), path, r["submitted_via"])
    merged = sketches.merge(sketches.load(spark, path))
    figures = {(c, "distinct"): F.count_distinct(c) for c in ("narrative", "company")} | {
        ("narrative_len", f"q{q:g}"): F.expr(f"percentile_disc({q}) within group (order by narrative_len)") for q in (0.5, 0.95)}
    exact = rows.agg(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(figures.values())]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), F.col(f"x{i}").alias("exact")) for i, (c, m) in enumerate(figures)])))
    within = F.col("exact").between(F.col("low"), F.col("high"))
    return sketches.estimates(merged).join(exact, ["column", "metric"]).select("column", "metric", "exact", within.alias("within_bounds"))


_MISSING = " union all ".join(f"""select '{c}' as "column", round(100.0 * count(*) filter ({c} is null) / count(*), 6)::double
    as missing_pct from complaints""" for c in _CLEAN_COLS)


@query("missing_pct", with_ctes(["complaints"], _MISSING))
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "complaints")
    return rounded(profiling.missing_pct(rows.select(_CLEAN_COLS)), "missing_pct")


_HISTOGRAM = {
    "v": "select least(narrative_len, 5000)::double as v from complaints",
    "e": "select min(v) as lo, (max(v) - min(v)) / 60 as w from v",
    "c": "select least(floor((v - lo) / w), 59)::int as bin, count(*) as n from v, e group by 1",
    "s": "select range::int as bin from range(60)",
}


@query("length_histogram", with_ctes(["complaints"], """
    select s.bin, round(e.lo + s.bin * e.w, 6) as bin_left, coalesce(c.n, 0)::bigint as n
    from s cross join e left join c on c.bin = s.bin""", _HISTOGRAM))
def _(spark, sf_dir):
    return rounded(profiling.length_histogram(view(spark, sf_dir, "complaints")), "bin_left")


@query("monthly_volume", with_ctes(["complaints"], """
    select m::date as month, count(complaint_id) as n
    from (select unnest(generate_series(date_trunc('month', min(date_received)), date_trunc('month', max(date_received)),
                 interval 1 month)) as m from complaints) s
    left join complaints g on date_trunc('month', g.date_received) = s.m group by 1"""))
def _(spark, sf_dir):
    return profiling.monthly_volume(view(spark, sf_dir, "complaints"))


@query("class_share_by_year", with_ctes(["complaints"], """
    select y as year, t.product, round(count(c.product)::double / any_value(tot), 6) as share
    from (select year(date_received)::int as y, count(*) as tot from complaints
          where product in (select product from t) group by 1) ys
    cross join t left join complaints c on c.product = t.product and year(c.date_received) = ys.y
    group by y, t.product""",
    {"t": "select product from complaints group by product order by count(*) desc, product limit 3"}))
def _(spark, sf_dir):
    return rounded(profiling.class_share_by_year(view(spark, sf_dir, "complaints"), top_k=3), "share")


_CARD_KEYS = ["rows", "date_min", "date_max", "n_classes", "majority_class", "minority_class", "minority_count",
              "narrative_len_median", "narrative_len_p95", "duplicate_narratives", "n_companies"]
# Shares as the card holds them, unrounded.
_CARD_SHARES = {"majority_share": "(select max(n) from b)::double / (select count(*) from complaints)",
                "imbalance_ratio": "(select max(n) from b)::double / (select min(n) from b)"}


@query("data_card", with_ctes(["complaints"],
    " union all ".join(f"select 'summary' as section, '{k}' as key, {k}::varchar as value from summary" for k in _CARD_KEYS)
    + "".join(f" union all select 'summary', '{k}', round({sql}, 6)::varchar" for k, sql in _CARD_SHARES.items())
    + " union all select 'class_count', product, n::varchar from b"
    + " union all select 'class_share', product, round_even(share, 3)::varchar from b"
    + ' union all select \'missing_pct\', "column", round_even(missing_pct, 1)::varchar from m',
    {"b": _BALANCE, "summary": _SUMMARY, "m": _MISSING}))
def _(spark, sf_dir):
    card = profiling.data_card(view(spark, sf_dir, "complaints").select(_CLEAN_COLS))
    share = F.col("key").isin(*_CARD_SHARES)
    return card.withColumn("value", F.when(share, F.round(F.col("value").cast("double"), 6).cast("string")).otherwise(F.col("value")))


# Split and guard.

SPLIT = {
    "ranked": "select *, row_number() over (order by date_received, complaint_id) - 1 as pos, count(*) over () as n from complaints",
    "split": """select * exclude (pos, n), case when pos >= trunc(n * (1::double - 0.1::double))::bigint then 'test'
                  when pos >= trunc(n * (1::double - 0.1::double - 0.1::double))::bigint then 'val' else 'train' end as split from ranked""",
    "deduped": """select * exclude (r) from (select *, row_number() over (partition by narrative, split = 'train'
                  order by date_received, complaint_id) r from split) where r = 1 or split <> 'train'""",
    "guarded": """select * from deduped d where split = 'train'
                  or not exists (select 1 from split t where t.split = 'train' and t.narrative = d.narrative)""",
    "frequent": "select product from guarded where split = 'train' group by product having count(*) >= 100",
    "final": "select * from guarded where product in (select product from frequent)",
}


def split_sql(body: str, step: str = "final", extra: dict[str, str] | None = None) -> str:
    names = list(SPLIT)
    return with_ctes(["complaints"], body, {n: SPLIT[n] for n in names[:names.index(step) + 1]} | (extra or {}))


@query("temporal_split", split_sql("select complaint_id, date_received, split from split", "split"))
def _(spark, sf_dir):
    return splitting.temporal_split(view(spark, sf_dir, "complaints")).select("complaint_id", "date_received", "split")


@query("dedupe_train", split_sql("select complaint_id, split, narrative_len from deduped", "deduped"))
def _(spark, sf_dir):
    rows = splitting.temporal_split(view(spark, sf_dir, "complaints"))
    return splitting.dedupe_train(rows).select("complaint_id", "split", "narrative_len")


@query("dedupe_train_late", split_sql("select complaint_id, split, narrative_len from deduped", "deduped"))
def _(spark, sf_dir):
    stored = late.located(materialize(view(spark, sf_dir, "complaints"), "complaints"))
    return late.dedupe_train(splitting.temporal_split(stored)).select("complaint_id", "split", "narrative_len")


@query("leakage_guard", split_sql("select complaint_id, split from guarded", "guarded"))
def _(spark, sf_dir):
    rows = splitting.temporal_split(view(spark, sf_dir, "complaints"))
    return splitting.leakage_guard(splitting.dedupe_train(rows)).select("complaint_id", "split")


@query("drop_rare_classes", split_sql("select complaint_id, product, split from final"))
def _(spark, sf_dir):
    rows = splitting.guarded_split(view(spark, sf_dir, "complaints"), min_class_count=100)
    return rows.select("complaint_id", "product", "split")


@query("split_class_balance", split_sql("select split, product, count(*) as n from final group by all"))
def _(spark, sf_dir):
    rows = splitting.guarded_split(view(spark, sf_dir, "complaints"), min_class_count=100)
    return rows.groupBy("split", "product").agg(F.count("*").alias("n"))


def _span(split: str) -> str:
    return f"coalesce((select min(date_received)::varchar || ';' || max(date_received)::varchar from final where split = '{split}'), '') as {split}_dates"


_META = f"""select
    (select count(*) from final where split = 'train') as n_train, (select count(*) from final where split = 'val') as n_val,
    (select count(*) from final where split = 'test') as n_test, {_span('train')}, {_span('val')}, {_span('test')},
    coalesce((select string_agg(product, ';' order by product) from frequent), '') as classes,
    coalesce((select string_agg(distinct product, ';' order by product) from complaints
              where product not in (select product from frequent)), '') as dropped_classes,
    '' as unseen_in_test,
    (select count(*) from deduped where split = 'val') - (select count(*) from guarded where split = 'val') as leaked_removed_val,
    (select count(*) from deduped where split = 'test') - (select count(*) from guarded where split = 'test') as leaked_removed_test"""


@query("split_meta", split_sql(_META))
def _(spark, sf_dir):
    meta = splitting.split_meta(view(spark, sf_dir, "complaints"), min_class_count=100)
    return joined(meta, "train_dates", "val_dates", "test_dates", "classes", "dropped_classes", "unseen_in_test")


@query("write_splits", split_sql("select complaint_id, product, split from final"))
def _(spark, sf_dir):
    source = view(spark, sf_dir, "complaints")
    rows = splitting.guarded_split(source, min_class_count=100)
    meta = splitting.split_meta(source, min_class_count=100)
    path = files.write_splits(rows, meta, work_path(spark, "splits"))
    return files.load_splits(spark, path).select("complaint_id", "product", "split")


@query("clean_split_balance", clean_sql(
    "select split, product, count(*) as n from final group by all", "cleaned",
    {"complaints": "select * from cleaned"} | SPLIT))
def prepared_balance(spark: SparkSession, sf_dir: str, min_class_count: int = 100) -> DataFrame:
    """From raw export to guarded split: rows per split and class."""
    stored = files.load_clean(spark, files.write_clean(cleaning.clean(raw_export(spark, sf_dir)), work_path(spark, "clean")))
    rows = splitting.guarded_split(stored, min_class_count=min_class_count)
    return rows.groupBy("split", "product").agg(F.count("*").alias("n"))
