import datetime as dt
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textroute.operators import evaluation, explanation, features, linear
from textroute.session import materialize, work_path

TOPICS = {"Credit card": "the card company charged a late fee on my statement",
          "Mortgage": "my escrow payment rose and the servicer did not explain",
          "Student loan": "the loan servicer lost my income driven repayment forms"}


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i * 10 + j, dt.date(2024, 1, 1), "BANK", product, f"{text} ref {i}", "Web", len(text))
            for i in range(40) for j, (product, text) in enumerate(TOPICS.items())]
    return materialize(spark.createDataFrame(
        rows, "complaint_id long, date_received date, company string, product string, narrative string, submitted_via string, narrative_len int"))


@pytest.fixture(scope="module")
def model(toy):
    return linear.fit(toy, max_iter=100)


def test_separable_texts_are_learnt(toy, model):
    proba = linear.predict_proba(toy, model)
    rows = linear.predict(proba, model.classes).join(toy, "complaint_id")
    assert rows.agg(F.avg((F.col("pred") == F.col("product")).cast("int"))).first()[0] > 0.95
    sums = [sum(r["p"]) for r in proba.collect()]
    assert len(sums) == 120 and all(abs(s - 1) < 1e-9 for s in sums)


def test_saved_model_predicts_the_same(spark, toy, model):
    again = linear.load_model(spark, linear.save_model(model, work_path(spark, "model")))
    a = {r["complaint_id"]: r["p"] for r in linear.predict_proba(toy, model).collect()}
    b = {r["complaint_id"]: r["p"] for r in linear.predict_proba(toy, again).collect()}
    assert a.keys() == b.keys() and all(x == pytest.approx(y) for k in a for x, y in zip(a[k], b[k]))


def test_record_without_known_terms_gets_the_intercepts(spark, model):
    df = spark.createDataFrame([(1, ""), (2, "zzzz")], "complaint_id long, narrative string")
    got = {r["complaint_id"]: r["z"] for r in linear.logits(df, model).collect()}
    assert got[1] == pytest.approx(model.intercepts) and len(got) == 2


def test_route_counts_on_unrounded_confidence(spark):
    df = spark.createDataFrame([(1, [0.59999, 0.3, 0.1, 0.00001]), (2, [0.6, 0.2, 0.1, 0.1])], "complaint_id long, p array<double>")
    got = {r["complaint_id"]: r for r in linear.route(df, ["a", "b", "c", "d"]).collect()}
    assert got[1]["needs_review"] and got[1]["confidence"] == 0.6 and not got[2]["needs_review"]
    assert [t["class"] for t in got[2]["top3"]] == ["a", "b", "c"]


def test_scoring_moves_only_raw_rows(toy, model):
    """One exchange brings the texts together by id; terms and weights are then combined in place."""
    plan = linear.logits(toy, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def python_char_grams(text):
    grams = Counter()
    for w in text.lower().split():
        w = f" {w} "
        for n in range(3, 6):
            for i in range(len(w) - n + 1):
                grams[w[i:i + n]] += 1
            if len(w) <= n:
                break
    return grams


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab é1_-.\t\nÀ", max_size=30), min_size=1, max_size=8))
def test_terms_match_a_plain_count(spark, texts):
    import regex
    df = spark.createDataFrame(list(enumerate(texts)), "complaint_id long, narrative string")
    words, chars = {}, {}
    for r in features.word_terms(df).collect():
        words.setdefault(r["complaint_id"], Counter())[r["term"]] = r["tf"]
    for r in features.char_terms(df).collect():
        chars.setdefault(r["complaint_id"], Counter())[r["term"]] = r["tf"]
    for i, t in enumerate(texts):
        tokens = regex.findall(r"\b\w\w+\b", t.lower())
        assert words.get(i, Counter()) == Counter(tokens) + Counter(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))
        assert chars.get(i, Counter()) == python_char_grams(t)


def test_vocabulary_cut_is_exact_with_ties(spark):
    counts = [("aa", 5), ("bb", 3), ("cc", 3), ("dd", 3), ("ee", 1)]
    rows = [(i, "word", t, 1) for t, n in counts for i in range(n)]
    terms = spark.createDataFrame(rows, "complaint_id long, block string, term string, tf long")
    got = [r["term"] for r in features.vocabulary(terms, min_df={"word": 1}, max_features={"word": 3}).orderBy("term").collect()]
    assert got == ["aa", "bb", "cc"]
    full = features.vocabulary(terms, min_df={"word": 2}, max_features={"word": 99})
    assert full.count() == 4


@pytest.fixture(scope="module")
def four(spark):
    rows = [(1, "A", "A", 0.9, 0.1), (2, "A", "B", 0.2, 0.8), (3, "B", "B", 0.3, 0.7), (4, "B", "B", 0.1, 0.9)]
    records = spark.createDataFrame([(i, dt.date(2024, 1, 1), "c", y, "text", "Web", 100 * i) for i, y, *_ in rows],
                                    "complaint_id long, date_received date, company string, product string, narrative string, submitted_via string, narrative_len int")
    proba = spark.createDataFrame([(i, a, b) for i, _, _, a, b in rows], "complaint_id long, A double, B double")
    p = evaluation.align_proba(records, proba, ["A", "B"])
    return records, proba, evaluation.predictions_table(p, ["A", "B"])


def test_metrics_of_four_rows(four):
    _, _, preds = four
    assert evaluation.accuracy(preds).first()[0] == 0.75
    errors = evaluation.error_sample(preds).collect()
    assert len(errors) == 1 and errors[0]["confidence"] == pytest.approx(0.8)
    f1 = evaluation.f1_averages(preds, ["A", "B"]).first()
    assert f1["macro_f1"] == pytest.approx((2 / 3 + 0.8) / 2)
    loss = evaluation.log_loss(preds).first()[0]
    assert loss == pytest.approx(-sum(math.log(p) for p in (0.9, 0.2, 0.7, 0.9)) / 4)
    with_absent = {r["class"]: r for r in evaluation.per_class_f1(preds, ["A", "B", "C"]).collect()}
    assert with_absent["C"]["f1"] == 0 and with_absent["C"]["support"] == 0


def test_confusion_has_all_pairs(four):
    _, _, preds = four
    got = {(r["truth"], r["pred"]): (r["n"], r["share"]) for r in evaluation.confusion_matrix(preds, ["A", "B", "C"]).collect()}
    assert len(got) == 9 and got["A", "B"] == (1, 0.5) and got["C", "A"] == (0, 0.0)


def test_calibration_edges(spark):
    df = spark.createDataFrame([("A", "A", c) for c in (0.3, 0.30000000000000004, 1.0, 0.0)], "product string, pred string, confidence double")
    got = {r["bin"]: r["n"] for r in evaluation.calibration(df).collect()}
    assert got == {0: 1, 2: 1, 3: 1, 9: 1}


def test_alignment_fails_loudly(spark, four):
    records, proba, _ = four
    for bad in (proba.filter("complaint_id < 4"), proba.union(proba.limit(1)), proba.withColumnRenamed("B", "C")):
        with pytest.raises(evaluation.AlignmentError):
            evaluation.align_proba(records, bad, ["A", "B"])


def test_length_buckets_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(200,), (201,), (0,), (10**7,), (10**7 + 1,)], "n int")
    assert [r[0] for r in df.select(explanation.length_bucket(F.col("n"))).collect()] == ["<200", "200-500", None, ">5k", None]


def test_slices_average_over_present_classes(four):
    records, _, preds = four
    rows = explanation.join_slice_attributes(preds, records)
    got = {r["submitted_via"]: r for r in explanation.slice_by_channel(rows).collect()}
    assert got["Web"]["n"] == got["(all)"]["n"] == 4
    by_length = {r["length_bucket"]: r for r in explanation.slice_by_length(rows).collect()}
    # Rows 1 and 2 (lengths 100 and 200): classes A and B are both present.
    assert by_length["<200"]["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)


def test_explanations_add_up_to_the_logit(toy, model):
    one = toy.filter("complaint_id = 10")
    told = explanation.explain_rows(one, model, k=10_000).first()
    parts = {x["feature"]: x["contribution"] for x in [*told["pushed_for"], *told["pushed_against"]]}
    z = linear.logits(one, model).first()["z"]
    at = model.classes.index(told["pred"])
    assert sum(parts.values()) + model.intercepts[at] == pytest.approx(z[at], abs=0.2)
    assert any(name.startswith("char:") for name in parts) and told["runner_up"] != told["pred"]


def test_top_features_name_the_topic(model):
    got = {r["class"]: r["top_features"] for r in explanation.top_features_per_class(model, k=40).collect()}
    assert "escrow" in got["Mortgage"] and "card" in got["Credit card"]


def test_rows_without_terms_are_trained_on(spark, toy, monkeypatch):
    """They move the intercepts: a class that only has such rows is the answer for a text without terms."""
    seen = {}
    fitter = linear.LogisticRegression.fit

    def fit(self, rows):
        seen["rows"], seen["weights"] = rows.count(), rows.agg(F.sum("weight")).first()[0]
        return fitter(self, rows)
    monkeypatch.setattr(linear.LogisticRegression, "fit", fit)
    blank = toy.limit(20).withColumn("complaint_id", F.col("complaint_id") + 100_000).withColumn("product", F.lit("Other")).withColumn("narrative", F.lit("? !"))
    model = linear.fit(toy.unionByName(blank), max_iter=50)
    assert seen["rows"] == 140 and seen["weights"] == pytest.approx(140)
    rows = spark.createDataFrame([(1, "!!")], "complaint_id long, narrative string")
    assert linear.predict(linear.predict_proba(rows, model), model.classes).first()["pred"] == "Other"


def test_fixed_model_tells_classes_apart(spark):
    import __spark_entry__ as entry
    rows = entry.queries()["route"](spark, "/root/testdata/sf0.01").groupBy("product", "needs_review").count().collect()
    assert {r["product"] for r in rows} == {"de", "en", "es", "fr"} and {r["needs_review"] for r in rows} == {True, False}


def test_fit_needs_no_session_setting(spark, toy):
    """Arrow is off and settings have their defaults, as in a session that isn't built here."""
    plain = spark.newSession()
    for key in ("spark.sql.execution.arrow.pyspark.enabled", "spark.sql.shuffle.partitions"):
        plain.conf.unset(key)
    plain.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    rows = plain.createDataFrame([tuple(r) for r in toy.limit(30).collect()], toy.schema)
    model = linear.fit(rows, max_iter=5, blocks=("word",))
    assert len(model.intercepts) == len(model.classes) and model.terms.count() > 0


def test_metrics_read_the_predictions_once(four):
    _, _, preds = four
    stored = materialize(preds.withColumn("model", F.lit("m")).withColumn("split", F.lit("test")))
    plan = evaluation.evaluate(stored, ["A", "B"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
