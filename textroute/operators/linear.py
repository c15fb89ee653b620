"""The linear classifier: fitted by passes over stored vectors, stored and applied as tables."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_LIMIT_BYTES, materialize, serialized_bytes
from . import features as feat
from .logistic import LogisticRegression, blobs

REVIEW_THRESHOLD = 0.6
# A fitted model's largest partial derivative of the mean loss; the solver goes on to a tenth of it.
SLOPE_TOLERANCE = 1e-4


@dataclass
class LinearModel:
    """`terms`: (block, term, idf, weights) with one weight per class in the order of `classes`."""
    classes: list[str]
    intercepts: list[float]
    terms: DataFrame
    blocks: tuple[str, ...] = (feat.WORD_BLOCK, feat.CHAR_BLOCK)


def class_list(df: DataFrame, label: str = "product") -> list[str]:
    """The label set, ascending. It is part of the model, so it lives on the driver."""
    return [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def _indexed(vocab: DataFrame) -> DataFrame:
    """Number the terms 0..n-1 by (block, term); `max_features` bounds how many there are."""
    at = Window.orderBy("block", "term")
    return vocab.withColumn("index", (F.row_number().over(at) - 1).cast("int"))


def feature_vectors(df: DataFrame, vocab: DataFrame, blocks: tuple[str, ...], id_col: str, text: str) -> DataFrame:
    """`(id, indices, values)`: one sparse vector per record over a numbered vocabulary, empty for a record without a term.

    Both are little-endian bytes, 32-bit indices and doubles.
    """
    shared = df.sparkSession.sparkContext.broadcast(feat.KnownTerms(vocab, blocks, "index"))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, known = feat.Kinds(batches), shared.value
        number = [np.array(known.kept[b]["index"], np.int64) for b in blocks]
        for ids, found, _ in known.records(batches):
            at = np.concatenate([x[0] for x in found])
            index, value = np.concatenate([n[x[1]] for n, x in zip(number, found)]), np.concatenate([x[2] for x in found])
            order = np.lexsort([index, at])
            sizes = np.bincount(at, minlength=len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batches.kind), blobs(sizes, index[order].astype("<i4")), blobs(sizes, value[order].astype("<f8"))],
                names=[id_col, "indices", "values"])

    return feat.by_record(df, id_col, text, blocks).mapInArrow(valued, f"{feat.id_type(df, id_col)}, indices binary, values binary")


def _row_weight(train: DataFrame, classes: list[str], balanced: bool, label: str) -> Column:
    """What a row counts in the loss: 1, or the balanced weight of its class."""
    if not balanced:
        return F.lit(1.0)
    counts = {r[label]: r["balanced"] for r in feat.class_weights(train, label).collect()}
    return F.create_map(*[x for name in classes for x in (F.lit(name), F.lit(counts[name]))])[F.col(label)]


def fit(train: DataFrame, c: float = 4.0, balanced: bool = True, max_iter: int = 2000, tol: float = 1e-6,
        blocks: tuple[str, ...] = (feat.WORD_BLOCK, feat.CHAR_BLOCK),
        min_df: dict[str, int] | None = None, max_features: dict[str, int] | None = None,
        id_col: str = "complaint_id", text: str = "narrative", label: str = "product") -> LinearModel:
    """Multinomial logistic regression with an L2 penalty of inverse strength `c`.

    The executors hold the vectors; each step of the solver moves one gradient of the size of the
    coefficients (classes x vocabulary cap) through a tree aggregation.
    """
    spark = train.sparkSession
    wanted = dict(max_features or feat.MAX_FEATURES)
    # Counted twice rather than stored: the counts are many times the size of the texts.
    vocab = feat.text_vocabulary(train, id_col, text, blocks, min_df, {b: wanted[b] for b in blocks})
    n_docs = train.count()
    vocab = materialize(_indexed(feat.with_idf(vocab, n_docs)), "vocabulary")
    vectors = feature_vectors(train, vocab, blocks, id_col, text)

    classes = class_list(train, label)
    codes = F.create_map(*[x for i, name in enumerate(classes) for x in (F.lit(name), F.lit(i))])
    weight = _row_weight(train, classes, balanced, label)
    labelled = (train.select(id_col, label).join(vectors, id_col)
                     .select("indices", "values", codes[F.col(label)].alias("label"), weight.alias("weight")))
    rows = materialize(labelled, "training-rows")
    total, unlabelled = rows.agg(F.sum("weight"), F.count_if(F.col("label").isNull())).first()
    if unlabelled:
        raise ValueError(f"{unlabelled} records to learn from have no {label}")
    model = LogisticRegression(len(classes), vocab.count(), 1.0 / (c * total), max_iter, tol, SLOPE_TOLERANCE / 10).fit(rows)

    coefficients = list(enumerate(model.coefficients.T.tolist()))
    schema = T.StructType([T.StructField("index", T.IntegerType()),
                           T.StructField("weights", T.ArrayType(T.DoubleType()))])
    weights = spark.createDataFrame(coefficients, schema)
    table = materialize(vocab.join(weights, "index").select("block", "term", "idf", "weights"), "model-terms")
    return LinearModel(classes, [float(x) for x in model.intercepts], table, blocks)


def optimality(train: DataFrame, model: LinearModel, c: float = 4.0, balanced: bool = True,
               id_col: str = "complaint_id", text: str = "narrative", label: str = "product") -> DataFrame:
    """`(class, n, weight, mass, intercept_slope, slope)`: how far the model is from the optimum of its own loss on `train`.

    The loss, mean weighted cross-entropy plus an L2 penalty on the weights but not on the intercepts, is convex, so a
    gradient of zero proves the optimum whatever solver found the model. `weight` is the weight of the class's rows and
    `mass` the weighted probability that all rows give the class, equal at the optimum; `intercept_slope` is their
    difference over the weight of all rows, `slope` the largest partial derivative over the class's weights.

    Each task adds the residuals of its records, times their values, into arrays as long as the vocabulary.
    """
    k, classes = len(model.classes), model.classes
    weighted = train.select(id_col, text, F.col(label).alias("_label"), _row_weight(train, classes, balanced, label).alias("_weight"))
    total = weighted.agg(F.sum("_weight")).first()[0]
    missed = [F.col("p")[i] - (F.col("_label") == name).cast("double") for i, name in enumerate(classes)]
    residuals = materialize(
        weighted.join(predict_proba(train, model, id_col, text), id_col)
                .select(id_col, text, "_label", "_weight", "p", *[(F.col("_weight") * m / total).alias(f"r{i}") for i, m in enumerate(missed)]),
        "residuals")
    pulls = feat.term_sums(residuals, model.terms, {f"s{i}": F.col(f"r{i}") for i in range(k)}, id_col, text, model.blocks)
    slopes = model.terms.join(pulls, ["block", "term"], "left").agg(*[
        F.max(F.abs(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.col("weights")[i] / (c * total))).alias(f"g{i}") for i in range(k)])
    sums = residuals.agg(*[x for i, name in enumerate(classes) for x in (
        F.count_if(F.col("_label") == name).alias(f"n{i}"), F.sum(F.when(F.col("_label") == name, F.col("_weight")).otherwise(0.0)).alias(f"w{i}"),
        F.sum(F.col("_weight") * F.col("p")[i]).alias(f"m{i}"), F.sum(f"r{i}").alias(f"b{i}"))])
    # One row each: the sums of the residuals and the largest slopes.
    rows = [F.struct(F.lit(name).alias("class"), F.col(f"n{i}").alias("n"), F.col(f"w{i}").alias("weight"), F.col(f"m{i}").alias("mass"),
                     F.col(f"b{i}").alias("intercept_slope"), F.coalesce(F.col(f"_g.g{i}"), F.lit(0.0)).alias("slope"))
            for i, name in enumerate(classes)]
    return sums.withColumn("_g", slopes.select(F.struct("*")).scalar()).select(F.inline(F.array(*rows)))


def save_model(model: LinearModel, path: str) -> str:
    """Two Parquet tables: one row per term, one row per class."""
    spark = model.terms.sparkSession
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    rows = [(i, name, b, list(model.blocks)) for i, (name, b) in enumerate(zip(model.classes, model.intercepts))]
    (spark.createDataFrame(rows, "position int, class string, intercept double, blocks array<string>")
          .write.mode("overwrite").parquet(f"{path}/classes"))
    return path


def load_model(spark: SparkSession, path: str) -> LinearModel:
    rows = spark.read.parquet(f"{path}/classes").orderBy("position").collect()
    return LinearModel([r["class"] for r in rows], [r["intercept"] for r in rows],
                       spark.read.parquet(f"{path}/terms"), tuple(rows[0]["blocks"]))


def model_from_tables(coef: DataFrame, intercepts: dict[str, float], vocab: DataFrame) -> LinearModel:
    """A model from a long `(class, block, term, w)` table; a missing weight counts as 0."""
    classes = sorted(intercepts)
    by_class = F.map_from_entries(F.collect_list(F.struct("class", "w")))
    weights = F.array(*[F.coalesce(F.try_element_at("_w", F.lit(c)), F.lit(0.0)) for c in classes])
    wide = coef.groupBy("block", "term").agg(by_class.alias("_w")).withColumn("weights", weights)
    table = wide.join(vocab.select("block", "term", "idf"), ["block", "term"])
    blocks = tuple(r[0] for r in vocab.select("block").distinct().orderBy("block").collect())
    return LinearModel(classes, [intercepts[c] for c in classes],
                       materialize(table.select("block", "term", "idf", "weights"), "model-terms"), blocks)


def logits(df: DataFrame, model: LinearModel, id_col: str = "complaint_id", text: str = "narrative") -> DataFrame:
    """`(id, z)`: one logit per class in the model's order, also for records without known terms.

    Texts come together by id and are scored record by record. A model too large for a task is joined instead.
    """
    if serialized_bytes(model.terms) > BROADCAST_LIMIT_BYTES:
        return joined_logits(df, model, id_col, text)
    shared = df.sparkSession.sparkContext.broadcast(RowScorer(model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, scorer = feat.Kinds(batches), shared.value
        for ids, found, _ in scorer.terms.records(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, batches.kind), pa.array(list(scorer.score(found, len(ids))), pa.list_(pa.float64()))], names=[id_col, "z"])

    rows = feat.by_record(df, id_col, text, model.blocks)
    return rows.mapInArrow(scored, f"{feat.id_type(df, id_col)}, z array<double>")


def joined_logits(df: DataFrame, model: LinearModel, id_col: str = "complaint_id", text: str = "narrative") -> DataFrame:
    """`logits` for a model of any size: each term row meets the model once and adds to one running sum per class.

    The length-1 scaling divides the sums, so values are never normalised row by row.
    """
    k = len(model.classes)
    terms = feat.term_counts(df, id_col, text, model.blocks, keep_empty=True)
    flat = model.terms.select("block", "term", "idf", *[F.col("weights")[i].alias(f"w{i}") for i in range(k)])
    weighted = feat.weighted_terms(terms, flat, how="left")
    sums = [F.sum(F.col("weight") * F.col(f"w{i}")).alias(f"s{i}") for i in range(k)]
    per_block = weighted.groupBy(id_col, "block").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), *sums)
    scored = per_block.groupBy(id_col).agg(*[F.sum(F.col(f"s{i}") / F.col("norm")).alias(f"z{i}") for i in range(k)])
    z = F.array(*[F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + F.lit(model.intercepts[i]) for i in range(k)])
    return scored.select(id_col, z.alias("z"))


def predict_proba(df: DataFrame, model: LinearModel, id_col: str = "complaint_id",
                  text: str = "narrative") -> DataFrame:
    """`(id, p)`: class probabilities as an array in the model's order (softmax, shifted by the maximum)."""
    scored = logits(df, model, id_col, text)
    return scored.select(id_col, softmax("z").alias("p"))


class RowScorer:
    """The model as arrays, for work within a row: `max_features` bounds what travels to the tasks."""

    def __init__(self, model: LinearModel) -> None:
        self.start = np.array(model.intercepts, np.float64)
        self.terms = feat.KnownTerms(model.terms, model.blocks, "weights")
        self.weights = {b: np.array(self.terms.kept[b].pop("weights"), np.float64).reshape(-1, len(model.classes)) for b in model.blocks}

    def score(self, found: feat.Terms, n: int) -> np.ndarray:
        """The logits of `n` rows."""
        z = np.tile(self.start, (n, 1))
        for block, (at, place, value) in zip(self.terms.blocks, found):
            for i, weights in enumerate(self.weights[block].T):
                z[:, i] += np.bincount(at, value * weights[place], n)
        return z

    def slices(self, batch: tuple[pd.Series, ...]) -> Iterator[tuple[int, feat.Terms]]:
        """A batch's rows, few at a time: how many, and their known terms."""
        kinds = {feat.WORD_BLOCK: pa.list_(pa.string()), feat.CHAR_BLOCK: pa.string()}
        for start in range(0, len(batch[0]), feat.ROWS):
            part = [pa.array(c.iloc[start:start + feat.ROWS], kinds[b], from_pandas=True) for b, c in zip(self.terms.blocks, batch)]
            yield len(part[0]), self.terms.rows(part)


def columns_of(batch: pd.Series | tuple[pd.Series, ...]) -> tuple[pd.Series, ...]:
    """The columns of a batch; a single one comes as it is."""
    return batch if isinstance(batch, tuple) else (batch,)


def row_logits(model: LinearModel) -> Callable[[Column], Column]:
    """A function from a text column to its logits, one array per row and no exchange.

    Texts are cut into terms by the same expressions as in `logits`, which also adds up the rows of an id.
    """
    scorer = RowScorer(model)

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([z for n, found in scorer.slices(columns_of(batch)) for z in scorer.score(found, n)])
    return lambda text: scores(*[feat.block_items(text)[b] for b in model.blocks])


def softmax(z: str) -> Column:
    """Class probabilities from an array of logits, shifted by the largest."""
    powers = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(z)))
    return F.transform(powers, lambda e: e / total)


def long_proba(proba: DataFrame, classes: list[str], id_col: str = "complaint_id") -> DataFrame:
    """`(id, class, p)` from the array form."""
    names = F.array(*[F.lit(c) for c in classes])
    return (proba.select(id_col, F.posexplode("p").alias("_i", "p"))
                 .select(id_col, F.element_at(names, F.col("_i") + 1).alias("class"), "p"))


def _ranked(classes: list[str]) -> Column:
    """Classes as `(class, p)`, most probable first, equal ones by name."""
    named = F.zip_with(F.array(*[F.lit(c) for c in classes]), "p",
                       lambda c, p: F.struct((-p).alias("minus_p"), c.alias("class"), p.alias("p")))
    return F.array_sort(named)


def predict(proba: DataFrame, classes: list[str], id_col: str = "complaint_id") -> DataFrame:
    """`(id, pred, confidence)`: the most probable class, the first by name among equals."""
    best = proba.select(id_col, _ranked(classes)[0].alias("b"))
    return best.select(id_col, F.col("b.class").alias("pred"), F.col("b.p").alias("confidence"))


def route(proba: DataFrame, classes: list[str], threshold: float = REVIEW_THRESHOLD,
          id_col: str = "complaint_id") -> DataFrame:
    """Top class, top three with probabilities to 4 digits, and whether a person must look.

    The review flag compares the unrounded confidence.
    """
    ranked = proba.select(id_col, _ranked(classes).alias("r"))
    top3 = F.transform(F.slice("r", 1, 3),
                       lambda x: F.struct(x["class"].alias("class"), F.bround(x["p"], 4).alias("p")))
    return ranked.select(
        id_col, F.col("r")[0]["class"].alias("product"),
        F.bround(F.col("r")[0]["p"], 4).alias("confidence"), top3.alias("top3"),
        (F.col("r")[0]["p"] < threshold).alias("needs_review"))
