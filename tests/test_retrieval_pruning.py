"""Groups of postings that can't hold a best chunk are left out, and product scopes are bitmaps."""
import random

import pytest
from pyspark.sql import functions as F

from textroute.operators import retrieval
from textroute.session import materialize

CHUNK = "id string, source string, title string, products array<string>, text string, position int"


def corpus(spark, n, products=("de", "en"), seed=3):
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(n):
        text = rng.choices(common, k=rng.randrange(0, 12)) + [f"rare{rng.randrange(n)}" for _ in range(rng.randrange(3))]
        rows.append((f"c#{i}", "c", "t", rng.choice([["all"], [rng.choice(products)], [*products], None, []]), " ".join(text), i))
    return materialize(spark.createDataFrame(rows, CHUNK).repartition(2))


def asked(spark, n, seed=5):
    rng = random.Random(seed)
    rows = [(i, " ".join([f"word{rng.randrange(30)}" for _ in range(rng.randrange(0, 5))] + [f"rare{rng.randrange(n)}" for _ in range(rng.randrange(3))]),
             rng.choice(["de", "en", "unlisted", "", None])) for i in range(60)]
    return materialize(spark.createDataFrame([*rows, (100, None, "de"), (101, "nothing known", None)], "query_id long, text string, product string"))


def answers(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("k", "block_chunks"), [(1, 5000), (4, 5000), (12, 100)])
def test_pruned_search_gives_the_same_chunks(spark, k, block_chunks):
    chunks, queries = corpus(spark, 300), asked(spark, 300)
    index = retrieval.build_index(chunks, block_chunks=block_chunks, group_chunks=4)
    assert index.n_groups > 20
    whole = retrieval.search(queries, index, k=k, seeds=10**6)
    assert answers(retrieval.search(queries, index, k=k, seeds=3)) == answers(whole)
    assert answers(whole) == answers(retrieval.search(queries, retrieval.build_index(chunks), k=k))


def test_fewer_postings_are_scored(spark):
    """Chunks with the rare words of a query are found without scoring those with its frequent ones."""
    chunks, n = corpus(spark, 1200), 1200
    index = retrieval.build_index(chunks, group_chunks=8)
    rng = random.Random(2)
    queries = materialize(spark.createDataFrame([(i, f"rare{rng.randrange(n)} word1 word2", None) for i in range(40)], "query_id long, text string, product string"))
    q = retrieval._scoped(queries, index, "product")
    total = retrieval.matched_groups(q, index, 0).agg(F.sum("size")).first()[0]
    first, rest = retrieval.needed_groups(q, index, 0, k=2, seeds=4)
    scored = sum(part.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for part in (first, rest))
    assert scored < 0.6 * total
    assert answers(retrieval.search(queries, index, k=2, seeds=4)) == answers(retrieval.search(queries, index, k=2, seeds=10**6))


def test_index_does_not_grow_with_the_products(spark):
    base = corpus(spark, 200, products=("p0", "p1"))
    many = base.withColumn("products", F.when(F.col("position") < 90, F.array(F.concat(F.lit("p"), F.col("position").cast("string")))).otherwise(F.array(F.lit("all"))))
    few = base.withColumn("products", F.when(F.col("position") < 90, F.array(F.lit("p0"))).otherwise(F.array(F.lit("all"))))
    sizes = []
    for chunks in (few, many):
        index = retrieval.build_index(chunks)
        sizes.append((index.postings.select(F.explode("items")).count(), index.places.select(F.explode("places")).count()))
    assert sizes[0] == sizes[1] and sizes[0][1] == 200 and len(index.products) == 90
    q = spark.createDataFrame([(1, "word1", "p7"), (2, "word1", None), (3, "word1", "other")], "query_id long, text string, product string")
    assert [r.n_candidates for r in retrieval.candidate_counts(q, index).orderBy("query_id").collect()] == [111, 200, 110]
    assert {r.id for r in retrieval.search(q, index, k=300).filter("query_id = 1").collect()} == {f"c#{i}" for i in [7, *range(90, 200)]}


def test_scopes_beyond_one_word_of_the_bitmap():
    sets = [(i, [f"p{i}"]) for i in range(70)] + [(70, ["all"])]
    scopes = {s: (words, classes) for s, words, classes in retrieval._scopes(sets, [f"p{i}" for i in range(70)])}
    words, classes = scopes["product:p63"]
    assert classes == [63, 70] and words == [-(1 << 63), 1 << 6] and scopes["general"] == ([0, 1 << 6], [70])
    assert scopes["any"][1] == list(range(71))


def test_empty_corpus(spark):
    index = retrieval.build_index(spark.createDataFrame([], CHUNK))
    q = spark.createDataFrame([(1, "word1", None)], "query_id long, text string, product string")
    assert retrieval.search(q, index).count() == 0 and retrieval.candidate_counts(q, index).first().n_candidates == 0
