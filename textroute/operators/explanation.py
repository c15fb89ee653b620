"""Why a record was routed as it was, and where the model does badly."""
from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_order
from ..session import fill_cores
from . import features as feat
from .evaluation import class_scores, pair_counts
from .linear import LinearModel, RowScorer, _ranked, columns_of, softmax

# Length buckets closed on the right, with their labels.
LENGTH_BUCKETS = [(200, "<200"), (500, "200-500"), (1000, "500-1k"), (2000, "1k-2k"),
                  (5000, "2k-5k"), (10**7, ">5k")]


def feature_name() -> Column:
    return F.when(F.col("block") == feat.CHAR_BLOCK, F.concat(F.lit("char:"), "term")).otherwise(F.col("term"))


def coefficients(model: LinearModel) -> DataFrame:
    """`(class, feature, w)` for every class and term."""
    names = F.array(*[F.lit(c) for c in model.classes])
    return (model.terms.select(feature_name().alias("feature"), F.posexplode("weights").alias("_i", "w"))
                 .select(F.element_at(names, F.col("_i") + 1).alias("class"), "feature", "w"))


def top_features_per_class(model: LinearModel, k: int = 15) -> DataFrame:
    """Per class the names of the `k` largest weights, largest first, ties by name."""
    rank = Window.partitionBy("class").orderBy(F.desc("w"), "feature")
    top = coefficients(model).withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "feature")))
    return top.groupBy("class").agg(F.concat_ws(", ", ordered["feature"]).alias("top_features"))


def explain_rows(df: DataFrame, model: LinearModel, k: int = 10, id_col: str = "complaint_id",
                 text: str = "narrative") -> DataFrame:
    """Per record: predicted class, confidence, runner-up, and the terms that pushed most for and against it.

    A term's contribution is its value times the predicted class's weight. Everything is found within the row: the class
    first, then the contributions to it, of which `k` on either side leave the row. Nothing is shuffled.
    """
    scorer, model_blocks = RowScorer(model), model.blocks
    side = "array<struct<feature:string,c:double>>"

    @F.pandas_udf(f"struct<z:array<double>,best:{side},worst:{side}>")
    def told(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n, found in scorer.slices(columns_of(batch)):
                z = scorer.score(found, n)
                best, pushed = np.argmax(np.exp(z - z.max(1, keepdims=True)), axis=1), [[] for _ in range(n)]
                for block, (at, place, value) in zip(model_blocks, found):
                    prefix = "char:" if block == feat.CHAR_BLOCK else ""
                    c = value * scorer.weights[block][place, best[at]]
                    for row, t, x in zip(at[c != 0].tolist(), scorer.terms.terms[block][place[c != 0]].tolist(), c[c != 0].tolist()):
                        pushed[row].append((prefix + t, x))
                # Compared rounded, so that sums taken in another order rank the same; ties by name.
                rows += [(z[i], nsmallest(k, told_of, key=lambda x: (-round(x[1], 9), x[0])),
                          nsmallest(k, (x for x in told_of if x[1] < 0), key=lambda x: (round(x[1], 9), x[0]))) for i, told_of in enumerate(pushed)]
            sides = [[[{"feature": f, "c": c} for f, c in x] for x in column] for column in ([r[1] for r in rows], [r[2] for r in rows])]
            yield pd.DataFrame({"z": [r[0] for r in rows], "best": sides[0], "worst": sides[1]})

    def shown(items: str) -> Column:
        return F.transform(items, lambda x: F.struct(x["feature"].alias("feature"), F.round(x["c"], 3).alias("contribution")))

    items = [feat.block_items(F.col(text))[b] for b in model.blocks]
    rows = fill_cores(df.select(id_col, text), id_col).select(id_col, told(*items).alias("t")).select(id_col, "t.*")
    rows = rows.withColumn("p", softmax("z")).withColumn("r", _ranked(model.classes))
    return rows.select(
        id_col, F.col("r")[0]["class"].alias("pred"), F.col("r")[0]["p"].alias("confidence"),
        F.try_element_at("r", F.lit(2))["class"].alias("runner_up"), shown("best").alias("pushed_for"), shown("worst").alias("pushed_against"))


def example_ids(preds: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """`n` reproducibly drawn correct rows and the `n` most confident wrong ones."""
    right = (preds.filter("correct").orderBy(seeded_order(seed, "complaint_id"), "complaint_id").limit(n)
                  .select(F.lit("correct").alias("kind"), "complaint_id"))
    wrong = (preds.filter("not correct").orderBy(F.desc("confidence"), "complaint_id").limit(n)
                  .select(F.lit("error").alias("kind"), "complaint_id"))
    return right.unionByName(wrong)


def example_rows(preds: DataFrame, model: LinearModel, n: int = 5, k: int = 10, seed: int = 0) -> DataFrame:
    """The example rows with their explanations. At most `2 n` ids, so they are broadcast."""
    chosen = F.broadcast(example_ids(preds, n, seed))
    rows = preds.join(chosen, "complaint_id").select("kind", "complaint_id", "product", "narrative")
    return rows.join(explain_rows(rows, model, k), "complaint_id")


def join_slice_attributes(preds: DataFrame, test: DataFrame) -> DataFrame:
    return preds.join(test.select("complaint_id", "narrative_len", "submitted_via"), "complaint_id")


def length_bucket(c: Column) -> Column:
    """Label of the bucket; null at 0 or below and above the last edge."""
    label = F.lit(None).cast("string")
    for upper, name in reversed(LENGTH_BUCKETS):
        label = F.when(c <= upper, F.lit(name)).otherwise(label)
    return F.when(c > 0, label)


def slice_scores(df: DataFrame, key: str, label: str = "product") -> DataFrame:
    """`(key, n, accuracy, macro_f1)`; macro-F1 averages over the classes present in the slice.

    Rows are counted per (slice, truth, prediction) in the map tasks; the metrics work on those
    counts. Rows without a key are left out.
    """
    return _pair_scores(pair_counts(df, (key,), label).filter(F.col(key).isNotNull()), key)


def _pair_scores(pairs: DataFrame, key: str) -> DataFrame:
    """From one pass over the pairs: every row counts once as the support of its class."""
    return class_scores(pairs, (key,)).groupBy(key).agg(
        F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def slice_by_length(df: DataFrame) -> DataFrame:
    return slice_scores(df.withColumn("length_bucket", length_bucket(F.col("narrative_len"))), "length_bucket")


def slice_by_company(df: DataFrame, top: int = 10) -> DataFrame:
    """Scores of the `top` largest companies, largest first; all companies are scored from the same counts."""
    return slice_scores(df, "company").orderBy(F.desc("n"), "company").limit(top)


def slice_by_channel(df: DataFrame, label: str = "product") -> DataFrame:
    """Scores per submission channel and, as `(all)`, over everything.

    The overall counts are added up from those per channel, rows without a channel included.
    """
    pairs = pair_counts(df, ("submitted_via",), label)
    both = (pairs.withColumn("submitted_via", F.explode(F.array("submitted_via", F.lit("(all)"))))
                 .filter("submitted_via is not null")
                 .groupBy("submitted_via", "truth", "pred").agg(F.sum("n").alias("n")))
    return _pair_scores(both, "submitted_via")
