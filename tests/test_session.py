from pyspark.sql import functions as F

from textroute import session


def test_broadcast_hint_depends_on_the_measured_size(spark):
    big = session.materialize(spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("t")))
    rows = spark.range(10)
    assert session.serialized_bytes(big) > 100_000
    hinted = rows.join(session.broadcast_if_small(big), "id")
    plain = rows.join(session.broadcast_if_small(big, limit=1000), "id")
    assert "strategy=broadcast" in hinted._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plain._jdf.queryExecution().analyzed().toString()


def test_materialized_table_prunes_columns(spark):
    stored = session.materialize(spark.range(10).withColumn("t", F.lit("x")))
    plan = stored.select("id").filter("id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_shared_folder_follows_the_setting(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.work_path(spark, "a") != session.work_path(spark, "a")


def test_small_scans_are_spread(spark):
    few = session.materialize(spark.range(100).coalesce(1))
    assert session.fill_cores(few, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = spark.range(0, 100, 1, 64)
    assert session.fill_cores(many, "id").rdd.getNumPartitions() == 64
