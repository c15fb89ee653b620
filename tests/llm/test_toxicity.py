import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textroute.llm import toxicity as tx
from textroute.llm.samples import bounded_sample, held_out

DOCS = "doc_id long, text string, toxicity string, kind string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n, seed=4):
    """Texts of one vocabulary; every fourth holds some of five further words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioustnrl", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        text = rng.choices(vocabulary, k=rng.randint(20, 120))
        if i % 4 == 0:
            for _ in range(rng.randint(3, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(["gloomwort", "Frimble!", "quagsnap", "Vexhound", "mudbrain"]))
        out.append((i, " ".join(text), int(i % 4 == 0)))
    return out


def test_unseen_texts_are_told_apart():
    rows = corpus(400)
    model = tx.fit([t for _, t, y in rows[:300] if y], [t for _, t, y in rows[:300] if not y], 1 / 3)
    got = [(tx.score(t, model) >= tx.THRESHOLD, y) for _, t, y in rows[300:]]
    assert sum(p == y for p, y in got) >= 98
    # A long clean text stays clean, and the whole of a long text is read.
    clean = " ".join(t for _, t, y in rows if not y)
    assert tx.score(clean, model) < tx.THRESHOLD
    assert tx.score(clean + " mudbrain quagsnap gloomwort" * 40, model) > tx.score(clean, model)


def test_windows_cover_the_text():
    text = "".join(random.Random(0).choices("abc ", k=1000))
    whole = tx.codes(tx.folded(text, True))
    found = tx.windows(text)
    assert found[0] == whole[:4 * tx.WINDOW] and whole.endswith(found[-1])
    assert b"".join(w[:4 * tx.STEP] for w in found[:-1]) + found[-1] == whole
    assert tx.windows(None) == tx.windows("") == [b""]


@pytest.mark.parametrize("toxic, ordinary, low, high", [([], [], 0, 0.01), ([], ["some text"], 0, 0.01), (["some text"], [], 0.99, 1)])
def test_missing_classes(toxic, ordinary, low, high):
    assert low <= tx.score("any", tx.fit(toxic, ordinary)) <= high


def tables(spark):
    rows = corpus(240)
    docs = [(i, t, "x", "y") for i, t, _ in rows] + [(500, None, "", ""), (501, "", "", ""), (None, "no id mudbrain", "", ""), (3, rows[3][1], "x", "y"),
                                                      (502, rows[0][1] * 200, "", "")]
    labels = [(i, 1, y, None) for i, _, y in rows] + [(None, 1, 1, None), (1, 1, None, None), (2, None, 7, None), (3, 1, 0, None), (999, 1, 1, "")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_tables_with_odd_rows(spark):
    docs, labels = tables(spark)
    model = tx.train(docs, labels, ~held_out(F.col("id"), 3, 1))
    got = tx.judge(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert sum(by_id[i].predicted == (i % 4 == 0) for i in range(240)) >= 232
    assert by_id[500].score == by_id[501].score and by_id[502].predicted == 1
    again = tx.train(docs.repartition(7), labels.repartition(3), ~held_out(F.col("id"), 3, 1))
    assert again == model


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = tables(spark)
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id"), 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    learn = ~held_out(F.col("id"), 3, 1)
    assert tx.train(docs, labels, learn) == tx.train(docs, turned, learn)


def test_toxic_rows_are_dropped_with_all_columns_kept(spark):
    docs, labels = tables(spark)
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sum(i % 4 == 0 for i in ids if i is not None and i < 240) <= 4 and sum(i % 4 != 0 for i in ids if i is not None and i < 240) >= 176
    assert ids.count(3) == 2


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert tx.judge(docs, tx.train(docs, labels)).count() == 0
    assert tx.drop_toxic(tables(spark)[0], labels).count() == tables(spark)[0].count()


def test_samples_are_bounded_however_rows_repeat(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("kind"), F.when(F.col("id") < 2000, F.col("id") % 3).otherwise(F.col("id")).alias("key"))
    got = bounded_sample(rows, "kind", F.col("key"), 50).groupBy("kind").count().collect()
    assert all(r["count"] <= 50 for r in got) and bounded_sample(rows, "kind", F.col("key"), 5000).count() == 3000
    spread = spark.range(3000).select((F.col("id") % 3).alias("kind"), F.col("id").alias("key"))
    assert [r["count"] for r in bounded_sample(spread, "kind", F.col("key"), 50).groupBy("kind").count().collect()] == [50] * 3


def test_query_holds_out_and_separates(spark):
    sf_dir = "/root/testdata/sf0.1"  # fewer rows hold too few toxic ones of each language
    got = tx.op5(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert {r.held_out for r in got} == {True, False}
    scores = {y: np.array([r.score for r in got if r.held_out and r.toxic == y]) for y in (0, 1)}
    assert (scores[0] >= tx.THRESHOLD).mean() < 0.02
    assert (scores[1][:, None] > scores[0][None, :]).mean() + 0.5 * (scores[1][:, None] == scores[0][None, :]).mean() > 0.88
