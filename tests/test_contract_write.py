"""The contract checked while rows are written."""
import pytest
from pyspark.sql import functions as F

from textroute.operators import contract
from textroute.schemas import CLEAN_SCHEMA
from textroute.session import work_path


def rows(spark, n=200):
    values = {"long": F.col("id"), "int": F.lit(40), "date": F.lit("2020-01-01").cast("date"), "string": F.lit("x" * 40)}
    return spark.range(n).select(*[values[
        {"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())].cast(f.dataType).alias(f.name)
        for f in CLEAN_SCHEMA.fields])


def counted(spark, df):
    want = {r.rule: r.n_failed for r in contract.contract_failures(df).collect()}
    return contract.write_counted(df, work_path(spark, "counted")), want


@pytest.mark.parametrize("change", [
    lambda df: df, lambda df: df.limit(0), lambda df: df.drop("narrative", "complaint_id"), lambda df: df.withColumn("more", F.lit(1)),
    lambda df: df.withColumn("complaint_id", F.col("complaint_id") % 7),
    lambda df: df.withColumn("complaint_id", F.when(F.col("complaint_id") % 3 > 0, F.concat(F.lit("n"), "complaint_id"))),
    lambda df: df.withColumn("date_received", F.lit("1999-01-01")).withColumn("narrative", F.lit("short"))])
def test_same_counts_as_the_separate_check(spark, change):
    got, want = counted(spark, change(rows(spark)))
    assert got == want


def test_rows_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch
    base = rows(spark)
    stored = contract.write_valid(base.mapInPandas(count, base.schema), work_path(spark, "valid"))
    assert stored.count() == 200 and calls.value == 200
    assert stored.schema.simpleString() == CLEAN_SCHEMA.simpleString()


def test_all_breaches_are_raised_and_types_coerced(spark):
    with pytest.raises(contract.ContractError) as error:
        contract.write_valid(rows(spark).withColumns({"complaint_id": F.lit(1), "narrative": F.lit("short")}), work_path(spark, "invalid"))
    assert error.value.failures == {"unique:complaint_id": 199, "narrative_min_length": 200}
    text = rows(spark).withColumn("complaint_id", F.col("complaint_id").cast("string"))
    assert contract.write_valid(text, work_path(spark, "text")).schema["complaint_id"].dataType.simpleString() == "bigint"
