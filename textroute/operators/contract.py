"""The data contract of the clean table: breaches of every rule are counted, then reported together."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schemas import CLEAN_SCHEMA, EARLIEST_DATE, MIN_NARRATIVE_CHARS


class ContractError(ValueError):
    def __init__(self, failures: dict[str, int]):
        self.failures = failures
        super().__init__("; ".join(f"{rule}: {n}" for rule, n in sorted(failures.items())))


def _row_counts(df: DataFrame) -> dict[str, Column]:
    """What to count for each rule that looks at columns or single rows."""
    expected = CLEAN_SCHEMA.fieldNames()
    counts = {f"missing_column:{c}": F.lit(1 if c not in df.columns else 0) for c in expected}
    counts["unexpected_columns"] = F.lit(len(set(df.columns) - set(expected)))
    for field in CLEAN_SCHEMA.fields:
        if field.name not in df.columns:
            continue
        col, kind = F.col(field.name), field.dataType.simpleString()
        typed = F.expr(f"try_cast(`{field.name}` as {kind})")
        counts[f"type:{field.name}"] = F.count_if(col.isNotNull() & typed.isNull())
        if not field.nullable:
            counts[f"not_null:{field.name}"] = F.count_if(col.isNull())
    if "date_received" in df.columns:
        date = F.expr("try_cast(date_received as date)")
        counts["date_not_before_start"] = F.count_if(date < F.lit(EARLIEST_DATE).cast("date"))
    if "narrative" in df.columns:
        counts["narrative_min_length"] = F.count_if(F.length("narrative") < MIN_NARRATIVE_CHARS)
    if "narrative_len" in df.columns:
        length = F.expr("try_cast(narrative_len as int)")
        counts["narrative_len_min"] = F.count_if(length < MIN_NARRATIVE_CHARS)
    return counts


def _repeats(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an id."""
    repeats = df.groupBy("complaint_id").agg((F.count("complaint_id") - 1).alias("n")).filter("n > 0")
    return repeats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def contract_failures(df: DataFrame) -> DataFrame:
    """`(rule, n_failed)` for every rule, also those without a breach."""
    counts = _row_counts(df)
    one_row = df.agg(*[c.cast("long").alias(f"r{i}") for i, c in enumerate(counts.values())])
    if "complaint_id" in df.columns:
        # A count of its own, so that only the ids are shuffled and not the other counters with them.
        one_row = one_row.withColumn(f"r{len(counts)}", _repeats(df).scalar())
        counts["unique:complaint_id"] = None
    rules = [F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n_failed"))
             for i, rule in enumerate(counts)]
    return one_row.select(F.inline(F.array(*rules)))


def _coerced(df: DataFrame) -> DataFrame:
    return reduce(lambda out, f: out.withColumn(f.name, F.col(f.name).cast(f.dataType)),
                  CLEAN_SCHEMA.fields, df).select(CLEAN_SCHEMA.fieldNames())


def validate(df: DataFrame) -> DataFrame:
    """Raise with all breached rules, or return the rows coerced to the contract's types."""
    failed = {r["rule"]: r["n_failed"] for r in contract_failures(df).filter("n_failed > 0").collect()}
    if failed:
        raise ContractError(failed)
    return _coerced(df)


def write_counted(df: DataFrame, path: str) -> dict[str, int]:
    """Store the rows at a new `path` and return the same counts as `contract_failures`, taken during the write.

    The rows are computed once: an observation counts the breaches of single rows as they pass to the files. Only the
    stored ids are read again, for repeats. Columns keep their types here, so that any breach can be looked at.
    """
    seen = Observation("contract")
    columns = CLEAN_SCHEMA.fieldNames()
    failed = {f"missing_column:{c}": int(c not in df.columns) for c in columns}
    failed["unexpected_columns"] = len(set(df.columns) - set(columns))
    counts = {rule: c.cast("long").alias(rule) for rule, c in _row_counts(df).items() if rule not in failed}
    df = df.observe(seen, *counts.values()) if counts else df
    df.write.option("compression", "zstd").parquet(path)
    failed |= seen.get if counts else {}
    if "complaint_id" in df.columns:
        failed["unique:complaint_id"] = _repeats(df.sparkSession.read.schema(df.schema).parquet(path)).first()["n"]
    return failed


def write_valid(df: DataFrame, path: str) -> DataFrame:
    """`validate` for rows that are stored anyway: raise with all breached rules, or return the stored rows, coerced.

    Rows that breach the contract are at `path` all the same when this raises; publish the path after it returns.
    """
    failed = {rule: n for rule, n in write_counted(df, path).items() if n}
    if failed:
        raise ContractError(failed)
    return _coerced(df.sparkSession.read.schema(df.schema).parquet(path))
