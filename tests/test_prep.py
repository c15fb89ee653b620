import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textroute.functions.ranks import exact_percentiles, order_statistics
from textroute.operators import cleaning, contract, profiling, splitting
from textroute.schemas import CLEAN_SCHEMA, RAW_HEADERS, RAW_SCHEMA
from textroute.sources import files

KINDS = {"Mortgage": 9, "Student loan": 7, "Credit reporting": 6, "Debt collection": 5, "Credit card": 4}
FIRST_ID = 50_000
FAULTS = 6


def raw_rows(n):
    """Rows of an export, a fixed cycle of kinds and firms; the last six have a fault each that cleaning must drop."""
    rng = random.Random(11)
    kinds = [k for k, share in KINDS.items() for _ in range(share)]
    rows = []
    for i in range(n):
        kind, day = kinds[i * 13 % len(kinds)], dt.date(2019, 3, 1) + dt.timedelta(days=i * 1800 // n)
        said = " ".join(rng.choices(["they", "charged", "twice", "and", "never", "answered", "my", "letter", "about", kind.lower()], k=rng.randint(6, 30)))
        cells = dict.fromkeys(RAW_HEADERS) | {
            "Date received": day.isoformat(), "Product": kind, "Issue": f"Kind of trouble {i % 7}", "Company": f"Firm {i % 11} & Sons",
            "State": ["OR", "VT", "NM"][i % 3], "Submitted via": "Phone" if i % 4 else "Fax", "Timely response?": "No" if i % 5 else "Yes",
            "Consumer complaint narrative": f'Case {i}: {said},\nthen "nothing" more.', "Complaint ID": str(FIRST_ID + i)}
        rows.append(cells)
    for row, (header, value) in zip(rows[-FAULTS:], [
            ("Consumer complaint narrative", "   "), ("Consumer complaint narrative", "too few"), ("Consumer complaint narrative", "N/A"),
            ("Date received", "2021-13-01"), ("Date received", None), ("Product", None)], strict=True):
        row[header] = value
    return [tuple(r[h] for h in RAW_HEADERS) for r in rows]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(raw_rows(1000), RAW_SCHEMA)


def clean_row(spark, **cells):
    base = dict(complaint_id=1, date_received=dt.date(2020, 1, 1), product="A", sub_product=None, issue=None,
                sub_issue=None, narrative="x" * 30, company=None, state=None, submitted_via=None,
                company_response=None, timely_response=None, narrative_len=30)
    return tuple((base | cells)[c] for c in CLEAN_SCHEMA.fieldNames())


def test_clean_drops_faulty_rows_and_meets_the_contract(raw):
    out = cleaning.clean(raw)
    assert out.columns == CLEAN_SCHEMA.fieldNames()
    assert out.count() == 1000 - FAULTS
    assert contract.validate(out).schema.simpleString() == CLEAN_SCHEMA.simpleString()


def test_csv_round_trip_keeps_quotes_and_line_breaks(spark, raw, tmp_path):
    path = str(tmp_path / "csv")
    raw.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                      ignoreTrailingWhiteSpace=False).csv(path)
    back = files.scan_raw_csv(spark, path)
    assert back.exceptAll(raw).count() == 0 and back.count() == 1000
    out = files.load_clean(spark, files.write_clean(cleaning.clean(back), str(tmp_path / "clean")))
    assert out.count() == out.select("complaint_id").distinct().count() == 1000 - FAULTS


def test_csv_with_other_headers_fails(spark, raw, tmp_path):
    path = str(tmp_path / "csv")
    raw.withColumnRenamed("Product", "Ware").write.options(header=True).csv(path)
    with pytest.raises(Exception):
        files.scan_raw_csv(spark, path).count()


def test_null_tokens_strip_and_labels(spark):
    rows = raw_rows(20)
    at = RAW_HEADERS.index
    for i, (narrative, product) in enumerate([("N/A", "Mortgage"), ("  text long enough to keep \t", "Credit reporting"),
                                              ("text long enough to keep", " Money transfers ")], 3):
        r = list(rows[i])
        r[at("Consumer complaint narrative")], r[at("Product")] = narrative, product
        rows[i] = tuple(r)
    out = {r["complaint_id"]: r for r in cleaning.clean(spark.createDataFrame(rows, RAW_SCHEMA)).collect()}
    assert FIRST_ID + 3 not in out
    assert out[FIRST_ID + 4]["narrative"] == "text long enough to keep" and out[FIRST_ID + 4]["narrative_len"] == 24
    assert out[FIRST_ID + 4]["product"] == "Credit reporting or other personal consumer reports"
    assert out[FIRST_ID + 5]["product"] == "Money transfer, virtual currency, or money service"


def test_dates_without_padding_parse_and_junk_does_not(spark):
    texts = ["2024-1-5", "2024-01-05", "01/05/2024", "2024-02-30", "12024-01-01", "1500-01-01", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [r[0] for r in df.select(cleaning.tolerant_date(F.col("d"))).collect()]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None, None, None, None, None]


def test_malformed_id_fails_the_job(spark):
    df = spark.createDataFrame([("12x",)], "complaint_id string")
    with pytest.raises(Exception):
        cleaning.cast_ids(df).collect()


def test_row_cap_is_exact(raw):
    assert cleaning.clean(raw, max_rows=10).count() == 10


def test_contract_lists_every_breach(spark):
    rows = [clean_row(spark), clean_row(spark), clean_row(spark, complaint_id=2, narrative="short", narrative_len=5,
                                                          date_received=dt.date(2000, 1, 1))]
    df = spark.createDataFrame(rows, CLEAN_SCHEMA).withColumn("extra", F.lit(1)).drop("state")
    with pytest.raises(contract.ContractError) as error:
        contract.validate(df)
    assert error.value.failures == {
        "unique:complaint_id": 1, "narrative_min_length": 1, "narrative_len_min": 1, "date_not_before_start": 1,
        "unexpected_columns": 1, "missing_column:state": 1}


def test_contract_coerces_types(spark):
    df = spark.createDataFrame([clean_row(spark)], CLEAN_SCHEMA)
    text = df.select([F.col(c).cast("string") for c in df.columns])
    assert contract.validate(text).schema["complaint_id"].dataType.simpleString() == "bigint"
    bad = text.withColumn("complaint_id", F.lit("x"))
    with pytest.raises(contract.ContractError, match="type:complaint_id"):
        contract.validate(bad)


def test_dedupe_plan_limits_before_the_exchange(spark, raw):
    plan = cleaning.clean(raw)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_profile_of_one_value(spark):
    df = spark.createDataFrame([clean_row(spark, complaint_id=i) for i in range(3)], CLEAN_SCHEMA)
    hist = {r["bin"]: r["n"] for r in profiling.length_histogram(df).collect()}
    assert len(hist) == 60 and sum(hist.values()) == 3 and hist[30] == 3
    stats = profiling.summary_stats(df).first()
    assert stats["duplicate_narratives"] == 2 and stats["imbalance_ratio"] == 1.0


def test_months_without_rows_count_zero(spark):
    rows = [clean_row(spark, complaint_id=i, date_received=d) for i, d in
            enumerate([dt.date(2020, 1, 15), dt.date(2020, 4, 2)])]
    got = profiling.monthly_volume(spark.createDataFrame(rows, CLEAN_SCHEMA)).orderBy("month").collect()
    assert [r["n"] for r in got] == [1, 0, 0, 1]


def test_split_is_ordered_disjoint_and_free_of_leaks(spark, raw):
    clean = files.load_clean(spark, files.write_clean(cleaning.clean(raw), splitting_path(spark)))
    # Repeat one train text in every split.
    clean = clean.withColumn("narrative", F.when(F.col("complaint_id") % 10 == 0, "the same text again and again")
                             .otherwise(F.col("narrative")))
    out = splitting.guarded_split(clean, min_class_count=5)
    parts = {s: out.filter(F.col("split") == s) for s in ("train", "val", "test")}
    span = {s: p.agg(F.min("date_received"), F.max("date_received")).first() for s, p in parts.items()}
    assert span["train"][1] <= span["val"][0] and span["val"][1] <= span["test"][0]
    assert out.count() == out.select("complaint_id").distinct().count()
    train = {r[0] for r in parts["train"].select("narrative").collect()}
    later = {r[0] for r in out.filter("split <> 'train'").select("narrative").collect()}
    assert not train & later and len(train) == parts["train"].count()
    meta = splitting.split_meta(clean, min_class_count=5).first()
    assert meta["n_train"] == parts["train"].count() and meta["n_test"] == parts["test"].count()
    assert meta["unseen_in_test"] == [] and meta["leaked_removed_val"] > 0 and meta["leaked_removed_test"] > 0


def splitting_path(spark):
    from textroute.session import work_path
    return work_path(spark, "clean")


def test_split_when_one_day_holds_everything(spark):
    n = 1000
    df = spark.range(n).select((F.col("id") * 7919 % 100_003).alias("complaint_id"),
                               F.lit("2024-05-05").cast("date").alias("date_received"))
    out = {r["split"]: r["n"] for r in splitting.temporal_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert out == {"train": 800, "val": 100, "test": 100}
    ids = sorted(r[0] for r in df.select("complaint_id").collect())
    test_ids = {r[0] for r in splitting.temporal_split(df).filter("split = 'test'").select("complaint_id").collect()}
    assert test_ids == set(ids[900:])


def test_split_plan_has_no_exchange(spark, raw):
    clean = files.load_clean(spark, files.write_clean(cleaning.clean(raw), splitting_path(spark)))
    plan = splitting.temporal_split(clean)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("values", [
    [5], [1, 1, 1, 1], list(range(10_000)), [2**62 + i for i in range(50)], [-5, 2**40, 3, 3, 2**40 + 1]])
def test_order_statistics_match_sorting(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ranks = sorted({0, len(values) // 2, len(values) - 1})
    assert order_statistics(df, "v", ranks) == {r: sorted(values)[r] for r in ranks}


def test_exact_percentiles_match_the_builtin(spark):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 3) for _ in range(5000)] + [0.0] * 3000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.0), F.lit(1.0)))).first()[0]
    assert exact_percentiles(df, "v", [0.5, 0.95, 0.0, 1.0]) == pytest.approx(want, rel=1e-12)
    assert exact_percentiles(df.filter("v < 0"), "v", [0.5]) == [None]


@pytest.mark.parametrize("values", [
    [1.0, float("inf"), 2.0], [float("-inf"), float("inf")] * 3, [float("nan"), 1.0, float("nan"), 5.0], [-1.7e308, 1.7e308, 0.0], [5e-324, 0.0, 1e-323]])
def test_order_statistics_end_on_odd_doubles(spark, values):
    known = sorted(v for v in values if v == v)
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert order_statistics(df, "v", list(range(len(known)))) == dict(enumerate(known))
    low, high = exact_percentiles(df, "v", [0.0, 1.0])
    assert (low, high) == (known[0], known[-1])


def test_order_statistics_over_the_whole_long_range(spark):
    values = [-2**63, 2**63 - 1, 0, 2**63 - 2, 2**63 - 3, -2**63 + 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert order_statistics(df, "v", list(range(6))) == dict(enumerate(sorted(values)))
