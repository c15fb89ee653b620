"""The certificate of a fitted model: the gradient of its loss, against numpy and at other weights."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from textroute.operators import features, linear
from textroute.session import materialize

TOPICS = {"Card": "the card company charged a late fee on my statement", "Loan": "the servicer lost my loan forms",
          "Home": "my escrow payment rose and the servicer did not explain"}
CUTS = {"min_df": {"word": 1, "char": 1}}


@pytest.fixture(scope="module")
def rows(spark):
    """Classes of unequal size with words in common."""
    said = [(i * 10 + j, name, f"{text} ref {i % 7} my") for j, (name, text) in enumerate(TOPICS.items()) for i in range(12 * (j + 1))]
    said += [(9000 + i, "Card", "my servicer did lose a fee") for i in range(5)] + [(9100, "Home", ""), (9101, "Loan", "my servicer did lose a fee")]
    return materialize(spark.createDataFrame(said, "complaint_id long, product string, narrative string"))


@pytest.fixture(scope="module")
def model(rows):
    return linear.fit(rows, blocks=("word",), **CUTS)


def gradient(rows, model, c):
    """Dense numpy version from the same feature values."""
    known = [tuple(r) for r in model.terms.select("block", "term", "weights").collect()]
    at = {(b, t): i for i, (b, t, _) in enumerate(known)}
    w = np.array([x for _, _, x in known])
    people = [tuple(r) for r in rows.select("complaint_id", "product").orderBy("complaint_id").collect()]
    place, x = {p[0]: i for i, p in enumerate(people)}, np.zeros((len(people), len(known)))
    values = features.tfidf(features.term_counts(rows, blocks=("word",)), model.terms.select("block", "term", "idf"))
    for r in values.collect():
        x[place[r["complaint_id"]], at[r["block"], r["term"]]] = r["value"]
    y = np.array([[name == label for name in model.classes] for _, label in people], float)
    weight = (len(people) / (len(model.classes) * y.sum(0)))[y.argmax(1)]
    z = x @ w + np.array(model.intercepts)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    r = weight[:, None] * (p - y) / weight.sum()
    return r.sum(0), np.abs(x.T @ r + w / (c * weight.sum())).max(0), weight


def test_matches_numpy_at_any_weights(rows, model):
    moved = linear.LinearModel(model.classes, [b + 0.3 * i for i, b in enumerate(model.intercepts)],
                               materialize(model.terms.withColumn("weights", F.transform("weights", lambda w: w * 0.5 + 0.1))), model.blocks)
    for tried in (model, moved):
        got = {r["class"]: r for r in linear.optimality(rows, tried).collect()}
        sums, largest, weight = gradient(rows, tried, 4.0)
        for i, name in enumerate(model.classes):
            assert got[name]["intercept_slope"] == pytest.approx(sums[i], abs=1e-12)
            assert got[name]["slope"] == pytest.approx(largest[i], abs=1e-12)
            assert got[name]["weight"] == pytest.approx(weight.sum() / 3)
            assert got[name]["mass"] - got[name]["weight"] == pytest.approx(sums[i] * weight.sum(), abs=1e-9)


def test_fitted_model_is_optimal_and_others_are_not(rows, model):
    fitted = linear.optimality(rows, model).collect()
    worst = max(max(abs(r["intercept_slope"]), r["slope"]) for r in fitted)
    early = linear.fit(rows, blocks=("word",), max_iter=2, **CUTS)
    stopped = max(max(abs(r["intercept_slope"]), r["slope"]) for r in linear.optimality(rows, early).collect())
    print("fitted", worst, "stopped early", stopped)
    assert worst < linear.SLOPE_TOLERANCE < stopped
    # The same weights aren't the optimum of another penalty.
    assert max(r["slope"] for r in linear.optimality(rows, model, c=0.5).collect()) > linear.SLOPE_TOLERANCE


def test_unweighted_rows(rows):
    plain = linear.fit(rows, blocks=("word",), balanced=False, **CUTS)
    got = {r["class"]: r for r in linear.optimality(rows, plain, balanced=False).collect()}
    counts = {r["product"]: r["count"] for r in rows.groupBy("product").count().collect()}
    assert {name: r["n"] for name, r in got.items()} == counts == {name: r["weight"] for name, r in got.items()}
    assert all(r["mass"] == pytest.approx(r["weight"], rel=1e-2) for r in got.values())


def test_solver_stops_at_a_flat_gradient_after_few_steps(rows, monkeypatch):
    """Steps are scaled by the curvature: however small `tol` is, the gradient ends the fit."""
    seen, fitter = {}, linear.LogisticRegression.fit

    def fit(self, vectors):
        seen["fitted"] = fitter(self, vectors)
        return seen["fitted"]
    monkeypatch.setattr(linear.LogisticRegression, "fit", fit)
    model = linear.fit(rows, blocks=("word",), tol=0.0, **CUTS)
    assert seen["fitted"].steps <= 60
    assert max(max(abs(r["intercept_slope"]), r["slope"]) for r in linear.optimality(rows, model).collect()) <= linear.SLOPE_TOLERANCE / 10 * 1.001


def test_fit_refuses_records_without_a_label(rows):
    with pytest.raises(ValueError, match="no product"):
        linear.fit(rows.withColumn("product", F.when(F.col("product") != "Home", F.col("product"))), blocks=("word",), **CUTS)
