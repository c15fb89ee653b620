"""Metrics, calibration and error tables over predictions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded_order

EPS = 2.220446049250313e-16  # fixed value: spacing of doubles at 1, the clip of the log loss


class AlignmentError(ValueError):
    pass


def accuracy(preds: DataFrame, by: tuple[str, ...] = (), label: str = "product") -> DataFrame:
    hit = F.avg((F.col(label) == F.col("pred")).cast("int")).alias("accuracy")
    return preds.groupBy(*by).agg(hit)


def pair_counts(preds: DataFrame, by: tuple[str, ...] = (), label: str = "product") -> DataFrame:
    """`(by, truth, pred, n)`: everything the label metrics need, one small row per pair seen."""
    return (preds.groupBy(*by, F.col(label).alias("truth"), "pred").agg(F.count("*").alias("n")))


def class_scores(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`(by, class, support, predicted, hits, f1)` for classes seen as truth or as prediction."""
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))
    hits = F.when((F.col("truth") == F.col("pred")) & (F.col("support") > 0), F.col("n")).otherwise(0)
    per_class = (pairs.select(*by, "truth", "pred", "n", F.inline(sides))
                      .groupBy(*by, "class")
                      .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                           F.sum(hits).alias("hits")))
    total = F.col("support") + F.col("predicted")
    return per_class.withColumn("f1", F.when(total > 0, 2 * F.col("hits") / total).otherwise(0.0))


def _over_classes(keys: DataFrame, classes: list[str], name: str = "class") -> DataFrame:
    """One row per key and listed class."""
    return keys.withColumn(name, F.explode(F.array(*[F.lit(c) for c in classes])))


def per_class_f1(preds: DataFrame, classes: list[str], by: tuple[str, ...] = (),
                 label: str = "product") -> DataFrame:
    """F1 and support of every listed class; 0 where undefined."""
    scores = class_scores(pair_counts(preds, by, label), by)
    keys = preds.select(*by).distinct() if by else preds.sparkSession.range(1).select()
    spine = _over_classes(keys, classes)
    return (spine.join(scores, [*by, "class"], "left")
                 .select(*by, "class", F.coalesce("f1", F.lit(0.0)).alias("f1"),
                         F.coalesce("support", F.lit(0)).alias("support")))


def f1_averages(preds: DataFrame, classes: list[str], by: tuple[str, ...] = (),
                label: str = "product") -> DataFrame:
    """Mean F1 over the listed classes, plain and weighted by support."""
    weighted = F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0))
    return per_class_f1(preds, classes, by, label).groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"))


def log_loss(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    p = F.least(F.greatest(F.col("p_true"), F.lit(EPS)), F.lit(1.0 - EPS))
    return preds.groupBy(*by).agg(F.avg(-F.log(p)).alias("log_loss"))


def confusion_matrix(preds: DataFrame, classes: list[str], label: str = "product") -> DataFrame:
    """`(truth, pred, n, share)` for every pair of listed classes; shares add up to 1 per truth."""
    listed = F.array(*[F.lit(c) for c in classes])
    pairs = pair_counts(preds, (), label).filter(
        F.array_contains(listed, F.col("truth")) & F.array_contains(listed, F.col("pred")))
    by_truth = pairs.groupBy("truth").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("pred", "n"))).alias("seen"))
    rows = _over_classes(preds.sparkSession.range(1).select(), classes, "truth").join(by_truth, "truth", "left")
    n = F.coalesce(F.try_element_at("seen", "pred"), F.lit(0))
    return _over_classes(rows, classes, "pred").select(
        "truth", "pred", n.alias("n"),
        F.coalesce(F.try_divide(n.cast("double"), F.col("total")), F.lit(0.0)).alias("share"))


def calibration(preds: DataFrame, n_bins: int = 10, label: str = "product") -> DataFrame:
    """Mean confidence, observed accuracy and count per confidence bin; empty bins are left out.

    The bin is the number of inner edges at or below the confidence. The edges are the doubles
    `i * (1 / n_bins)`, some of which are not the nearest doubles to i/n_bins.
    """
    step = 1.0 / n_bins
    edges = [i * step for i in range(1, n_bins)]
    bin_no = reduce(lambda acc, e: acc + (F.col("confidence") >= F.lit(e)).cast("int"), edges, F.lit(0))
    return (preds.groupBy(bin_no.alias("bin"))
                 .agg(F.avg("confidence").alias("mean_confidence"),
                      F.avg((F.col(label) == F.col("pred")).cast("int")).alias("observed_accuracy"),
                      F.count("*").alias("n")))


def predictions_table(aligned: DataFrame, classes: list[str], label: str = "product") -> DataFrame:
    """Source columns with pred, correct, confidence and the probability of the true class.

    `aligned` holds the records with `p`, the probabilities in the order of `classes`.
    """
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_position("p", F.array_max("p")).cast("int")
    truth = F.nullif(F.array_position(names, F.col(label)), F.lit(0)).cast("int")
    return (aligned.select("complaint_id", "date_received", "company", label, "narrative", "p")
                   .withColumn("pred", F.element_at(names, best))
                   .withColumn("correct", F.col(label) == F.col("pred"))
                   .withColumn("confidence", F.array_max("p"))
                   .withColumn("p_true", F.element_at("p", truth))
                   .drop("p"))


def error_sample(preds: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """The `n` most confident wrong rows; without a confidence, a reproducible sample of wrong rows."""
    wrong = preds.filter(~F.col("correct"))
    if "confidence" in preds.columns:
        return wrong.orderBy(F.desc("confidence"), "complaint_id").limit(n)
    return wrong.orderBy(seeded_order(seed, "complaint_id"), "complaint_id").limit(n)


def evaluate(preds: DataFrame, classes: list[str], by: tuple[str, ...] = ("model", "split"),
             label: str = "product") -> DataFrame:
    """`(by, metric, value)`: accuracy, averages, log loss, and F1 and support per class.

    The predictions are read once, into a row for each pair of labels with its count and loss; every metric is
    a sum over those rows.
    """
    keys, losses = list(by), "p_true" in preds.columns
    p = F.least(F.greatest(F.col("p_true"), F.lit(EPS)), F.lit(1.0 - EPS)) if losses else F.lit(1.0)
    pairs = preds.groupBy(*keys, F.col(label).alias("truth"), "pred").agg(
        F.count("*").alias("n"), F.sum(-F.log(p)).alias("loss"), F.count(p).alias("known"))
    sides = F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                             F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"),
                             F.col("n").alias("rows"), F.col("loss").alias("loss"), F.col("known").alias("known")),
                    F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                             F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("loss"),
                             F.lit(0).cast("long").alias("known")))
    names = ["support", "predicted", "hits", "rows", "loss", "known"]
    per_class = pairs.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(*[F.sum(n).alias(n) for n in names])
    rows = (per_class.withColumn("side", F.struct("support", "predicted", "hits")).groupBy(*keys).agg(
        F.sum("hits").alias("hits"), F.sum("rows").alias("rows"), F.sum("loss").alias("loss"), F.sum("known").alias("known"),
        F.map_filter(F.map_from_entries(F.collect_list(F.struct(F.coalesce("class", F.lit("")), "side"))), lambda k, v: k != "").alias("sides")))

    def of(name: str) -> Column:
        side = F.try_element_at("sides", F.lit(name))
        support, predicted, hits = (F.coalesce(side[n], F.lit(0)) for n in ("support", "predicted", "hits"))
        total = support + predicted
        f1 = F.when(total > 0, 2 * hits / total).otherwise(0.0)
        return F.struct(F.lit(name).alias("class"), f1.alias("f1"), support.alias("support"))
    scored = rows.withColumn("classes", F.array(*[of(c) for c in classes]))
    supported = F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + c["support"])
    macro = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["f1"]) / len(classes)
    weighted = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["f1"] * c["support"])
    singles = [("accuracy", F.col("hits") / F.col("rows")), ("macro_f1", macro),
               ("weighted_f1", F.coalesce(F.try_divide(weighted, supported.cast("double")), F.lit(0.0)))]
    if losses:
        singles.append(("log_loss", F.try_divide(F.col("loss"), F.col("known").cast("double"))))
    each = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in singles])
    listed = F.flatten(F.transform("classes", lambda c: F.array(
        F.struct(F.concat(F.lit("f1:"), c["class"]).alias("metric"), c["f1"].alias("value")),
        F.struct(F.concat(F.lit("support:"), c["class"]).alias("metric"), c["support"].cast("double").alias("value")))))
    return scored.select(*keys, F.inline(F.concat(each, listed)))


def alignment_failures(split: DataFrame, proba: DataFrame) -> DataFrame:
    """How many ids are repeated on either side, and how many split rows have no probabilities."""
    left = split.groupBy("complaint_id").agg(F.count("*").alias("n_left"))
    right = proba.groupBy("complaint_id").agg(F.count("*").alias("n_right"))
    return left.join(right, "complaint_id", "full_outer").agg(
        F.count_if(F.col("n_left") > 1).alias("repeated_in_split"),
        F.count_if(F.col("n_right") > 1).alias("repeated_in_proba"),
        F.count_if(F.col("n_left").isNotNull() & F.col("n_right").isNull()).alias("missing"))


def scaled(columns: list[str]) -> Column:
    """Wide class columns as one array that adds up to 1."""
    p = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}`").cast("double") for c in columns])
    return F.transform(p, lambda x: x / total)


def align_proba(split: DataFrame, proba: DataFrame, classes: list[str]) -> DataFrame:
    """The split's rows with `p`: probabilities from elsewhere, matched one to one and scaled to sum 1.

    Raises when the class columns differ, an id repeats or a row has no probabilities.
    """
    found = [c for c in proba.columns if c != "complaint_id"]
    if sorted(found) != sorted(classes):
        raise AlignmentError(f"class lists differ: {sorted(found)} and {sorted(classes)}")
    failed = {k: v for k, v in alignment_failures(split, proba).first().asDict().items() if v}
    if failed:
        raise AlignmentError(f"rows do not match one to one: {failed}")
    wide = proba.select("complaint_id", scaled(classes).alias("p"))
    return split.join(wide, "complaint_id")


def compare_runs(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per run, one column per metric, from `(run, metric, value)`."""
    return metrics.groupBy("run").pivot("metric", names).agg(F.first("value"))
