"""Evaluation sets, judged drafts and their summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_order, words
from .drafting import case_ref


def stratified_eval_set(preds: DataFrame, n: int = 100, seed: int = 0, label: str = "product") -> DataFrame:
    """A reproducible sample of `n` rows, proportional per class with at least 3 where there are.

    Ranking inside a class stops at the largest possible quota in the map tasks, so a class that
    holds most rows is never gathered whole.
    """
    counts = preds.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    quotas = counts.select(F.col(label), F.greatest(F.bround(F.col("_n") / total * n), F.lit(3)).cast("int").alias("_quota"))
    rank = Window.partitionBy(label).orderBy(seeded_order(seed, "complaint_id"), "complaint_id")
    drawn = (preds.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= max(n, 3))
                  .join(quotas, label).filter("_rank <= _quota").drop("_rank", "_quota"))
    shuffled = drawn.orderBy(seeded_order(f"{seed}-order", "complaint_id"), "complaint_id").limit(n)
    return shuffled.withColumn("case_ref", case_ref(F.col("complaint_id")))


def latest_rows(cache: DataFrame, order: str, *keys: str) -> DataFrame:
    """One row per key of an append-only cache: the last one written."""
    rank = Window.partitionBy(*keys).orderBy(F.desc(order))
    return cache.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def pending_rows(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows that are not in the cache yet."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def _quoted(c: Column) -> Column:
    """The text between quotes with escapes, in the way the note has always shown it."""
    text = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for ch, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(ch), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(single)


def parse_judgment(df: DataFrame, raw: str = "raw", stop_reason: str = "stop_reason") -> DataFrame:
    """Add accuracy, grounding, tone, hallucination and note from the first `{...}` of a reply.

    `hallucination` follows truthiness: any non-empty text is true, even "false". A reply without
    valid JSON or without that key gives nulls and a note with the start of the reply.
    """
    found = F.nullif(F.regexp_extract(raw, r"(?s)\{.*?\}", 0), F.lit(""))
    verdict = F.try_variant_get("_json", "$.hallucination", "variant")
    kind, text = F.schema_of_variant("_verdict"), F.try_variant_get("_json", "$.hallucination", "string")
    truthy = (F.when(kind == "VOID", False)
               .when(kind == "BOOLEAN", text == "true")
               .when(kind == "STRING", F.length(text) > 0)
               .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
               .otherwise(text.try_cast("double") != 0))
    failed = F.concat(F.lit("unparseable ("), F.coalesce(F.col(stop_reason), F.lit("?")), F.lit("): "),
                      _quoted(F.substring(raw, 1, 80)))
    scores = {c: F.when(F.col("_verdict").isNotNull(), F.try_variant_get("_json", f"$.{c}", "double"))
              for c in ("accuracy", "grounding", "tone")}
    return (df.withColumn("_json", F.try_parse_json(found))
              .withColumn("_verdict", verdict)
              .withColumns(scores)
              .withColumn("hallucination", F.when(F.col("_verdict").isNotNull(), truthy))
              .withColumn("note", F.when(F.col("_verdict").isNotNull(), F.try_variant_get("_json", "$.note", "string"))
                                   .otherwise(failed))
              .withColumn(raw, F.substring(raw, 1, 500))
              .drop("_json", "_verdict"))


def merge_judgments(drafts: DataFrame, judgments: DataFrame, order: str | None = None) -> DataFrame:
    """Drafts with their verdicts. `order` tells which of several verdicts in the cache was written last and counts."""
    keys = ["condition", "complaint_id"]
    latest = latest_rows(judgments, order, *keys).drop(order) if order else judgments
    return drafts.join(latest, keys)


def summarize_conditions(merged: DataFrame) -> DataFrame:
    """Means per condition. `n_judged` tells how many rows have a verdict, since means skip the others."""
    return merged.groupBy("condition").agg(
        F.count("*").alias("n"), F.count("hallucination").alias("n_judged"),
        F.avg("accuracy").alias("accuracy"), F.avg("grounding").alias("grounding"), F.avg("tone").alias("tone"),
        F.avg(F.col("hallucination").cast("double")).alias("hallucination_rate"),
        F.avg(F.col("citations.ok").cast("double")).alias("citation_check_pass"),
        F.avg("cost_usd").alias("cost_per_draft_usd"), F.avg("latency_s").alias("latency_s"),
        F.avg(F.size(words(F.col("draft")))).alias("words_per_draft"))


def spot_check_sample(merged: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """A reproducible sample for reading by hand: excerpt, draft and verdict."""
    return (merged.orderBy(seeded_order(seed, "complaint_id"), "complaint_id").limit(n)
                  .select("complaint_id", "true_product", "pred_product",
                          F.substring("narrative", 1, 600).alias("excerpt"), "draft",
                          "accuracy", "grounding", "tone", "hallucination", "note"))


def hallucination_by(merged: DataFrame) -> DataFrame:
    """`(key, value, hallucination_rate, n)` by routing result, citation check and predicted product."""
    flags = merged.select(
        (F.col("true_product") == F.col("pred_product")).cast("string").alias("product_correct"),
        F.col("citations.ok").cast("string").alias("citation_ok"), "pred_product",
        F.col("hallucination").cast("double").alias("h"))
    keys = ["product_correct", "citation_ok", "pred_product"]
    grouped = flags.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(
        F.avg("h").alias("hallucination_rate"), F.count("*").alias("n"),
        *[F.grouping(k).alias(f"_{k}") for k in keys])
    key = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys])
    value = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.col(k)) for k in keys])
    return grouped.select(key.alias("key"), value.alias("value"), "hallucination_rate", "n").filter("value is not null")


def top_unsupported_timelines(drafts: DataFrame, k: int = 10) -> DataFrame:
    return (drafts.select(F.explode("citations.unsupported_timelines").alias("phrase"))
                  .groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(k))


def unparseable_judgments(judgments: DataFrame, order: str = "complaint_id") -> DataFrame:
    """Per condition the rows without a verdict, all rows, and the first three notes."""
    counts = judgments.groupBy("condition").agg(
        F.count_if(F.col("hallucination").isNull()).alias("n_unparseable"), F.count("*").alias("n"))
    rank = Window.partitionBy("condition").orderBy(order)
    first = (judgments.filter("hallucination is null").withColumn("_rank", F.row_number().over(rank))
                      .filter("_rank <= 3"))
    notes = first.groupBy("condition").agg(F.array_sort(F.collect_list(F.struct("_rank", "note")))["note"].alias("notes"))
    return (counts.join(notes, "condition", "left")
                  .withColumn("notes", F.coalesce("notes", F.array().cast("array<string>"))))


def drop_failed_judgments(judgments: DataFrame) -> DataFrame:
    """Rows with a verdict; write them to a new path so that the others are judged again."""
    return judgments.filter("hallucination is not null")


def kept_and_dropped(judgments: DataFrame) -> DataFrame:
    return judgments.groupBy("condition").agg(
        F.count("hallucination").alias("kept"), F.count_if(F.col("hallucination").isNull()).alias("dropped"))
