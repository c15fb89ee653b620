"""Hot keys: results stay whole and plans keep them out of a single task."""
from pyspark.sql import functions as F

from textroute.operators import cleaning, evaluation, explanation, judging, monitoring, splitting
from textroute.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_records(spark, n=6000):
    """A third of all rows share one text, one day, one class and one company."""
    hot = F.col("id") % 3 == 0
    return materialize(spark.range(n).select(
        F.col("id").alias("complaint_id"),
        F.when(hot, F.lit("2024-03-01").cast("date")).otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 120).cast("int"))).alias("date_received"),
        F.when(hot, "A").otherwise(F.concat(F.lit("B"), F.col("id") % 4)).alias("product"),
        F.when(hot, "one text that is sent in again and again").otherwise(F.concat(F.lit("a text of its own, number "), F.col("id"))).alias("narrative"),
        F.when(hot, "HOT").otherwise(F.concat(F.lit("C"), F.col("id") % 50)).alias("company")))


def test_split_with_a_hot_day_and_text(spark):
    df = hot_records(spark)
    split = splitting.temporal_split(df)
    n = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 4800, "val": 600, "test": 600}
    guarded = splitting.guarded_split(df, min_class_count=1)
    texts = guarded.groupBy("narrative").agg(F.count_distinct("split").alias("s"), F.count("*").alias("n"))
    assert texts.filter("s > 1 or n > 1").count() == 0
    assert guarded.count() == df.select("narrative").distinct().count() == 4001


def test_windows_are_limited_in_the_map_tasks(spark):
    df = hot_records(spark)
    repeated = df.withColumn("complaint_id", F.when(F.col("complaint_id") % 3 == 0, -1).otherwise(F.col("complaint_id")))
    limited = [
        cleaning.dedupe_ids(repeated),
        splitting.dedupe_train(df.withColumn("split", F.lit("train"))),
        judging.latest_rows(df, "date_received", "company"),
        judging.stratified_eval_set(df, n=50),
    ]
    for frame in limited:
        text = plan(frame)
        before_exchange = text[text.index("WindowGroupLimit"):]
        assert "Final" in before_exchange and "Partial" in before_exchange
    assert cleaning.dedupe_ids(repeated).count() == 4001


def test_no_plan_pairs_rows_without_a_key(spark):
    df = hot_records(spark).withColumns({"pred": F.lit("A"), "correct": F.lit(True), "confidence": F.lit(0.5),
                                         "p_true": F.lit(0.5), "submitted_via": F.concat(F.lit("ch"), F.col("complaint_id") % 3), "narrative_len": F.lit(10)})
    frames = [evaluation.confusion_matrix(df, ["A", "B0", "B1"]), evaluation.per_class_f1(df, ["A", "B0"]),
              explanation.slice_by_company(df), explanation.slice_by_channel(df),
              monitoring.psi(monitoring.distribution(df), monitoring.distribution(df))]
    for frame in frames:
        assert "CartesianProduct" not in plan(frame) and "BroadcastNestedLoopJoin" not in plan(frame)
        frame.collect()


def test_leak_guard_splits_a_hot_text_when_it_cannot_broadcast(spark, monkeypatch):
    """Beyond the size limit the anti join shuffles; the hot partition is then split at run time."""
    df = hot_records(spark, 30000).withColumn("split", F.when(F.col("complaint_id") % 10 == 0, "train").otherwise("test"))
    wide = df.withColumn("narrative", F.repeat("narrative", 20))
    monkeypatch.setattr(splitting, "broadcast_if_small", lambda frame: frame)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        leaked = materialize(splitting.leaked_digests(wide))
        out = splitting.leakage_guard(wide, leaked)
        rows = out.collect()
        assert "skew=true" in plan(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    train = {r["narrative"] for r in rows if r["split"] == "train"}
    assert not train & {r["narrative"] for r in rows if r["split"] == "test"}
