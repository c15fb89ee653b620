"""Small blocks are searched inside the tasks: no token becomes a row, and the answers stay those of the joins."""
import random

from pyspark.sql import functions as F

from textroute.functions.text import all_matches, search_tokens
from textroute.functions.patterns import unicode_pattern
from textroute.operators import block_scores, guardrails, retrieval
from textroute.session import materialize

CHUNK = "id string, source string, title string, products array<string>, text string, position int"
QUERY = "query_id long, text string, product string"


def corpus(spark, *more):
    rng = random.Random(4)
    rows = [(f"c#{i}", "c", "t", rng.choice([["all"], ["de"], ["en", "de"], None]), " ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randrange(9))), i)
            for i in range(80)]
    return materialize(spark.createDataFrame([*rows, *more], CHUNK))


def answers(df):
    return sorted(((r.query_id is not None, r.query_id), r.rank, str(r.id), round(r.score, 8)) for r in df.collect())


def joined(queries, index, k):
    """The same search by joining every term with its postings."""
    q = retrieval._scoped(queries, index, "product")
    scored = retrieval._scored(q, index, 0).filter("place is not null")
    scopes = index.scopes.select("scope", F.explode("classes").alias("cls"))
    places = index.places.select("cls", F.explode("places").alias("place"))
    rows = q.select("query_id", "scope").distinct().join(scopes, "scope").join(places, "cls").select("query_id", "scope", "place").distinct()
    same = rows["query_id"].eqNullSafe(scored["query_id"]) & (rows["scope"] == scored["scope"]) & (rows["place"] == scored["place"])
    rows = rows.join(scored, same, "left").select(rows["query_id"], rows["place"], F.coalesce("score", F.lit(0.0)).alias("score"))
    best = rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(retrieval._entry(F.col("place"), F.col("score")))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("r", "x")).select("query_id", (F.col("r") + 1).alias("rank"), "x.place.id", "x.score")


def test_no_token_becomes_a_row(spark):
    index = retrieval.build_index(corpus(spark))
    plan = retrieval.search(spark.createDataFrame([(1, "w1 w2", "de")], QUERY), index)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "HashAggregate" not in plan and "MapInArrow" in plan


def test_answers_are_those_of_the_joins(spark, monkeypatch):
    """Repeated and null ids, a place in two classes, places without id or source, and batches cut anywhere."""
    chunks = corpus(spark, ("c#3", "c", "t", ["es"], "w1 w1 w39", 3), (None, "c", "t", ["all"], "w1", 4), ("c#x", None, "t", ["all"], "w1 w2", None))
    index = retrieval.build_index(chunks)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"W{j}" for j in range(50)], k=rng.randrange(12))), rng.choice(["de", "en", "es", "", None, "other"])) for i in range(60)]
    rows += [(5, "w3 w4", rows[5][2]), (5, "w4", rows[5][2]), (None, "w1", "de"), (None, "w2 w2", "de"), (70, None, "es"), (71, "w39 w1", "es")]
    queries = materialize(spark.createDataFrame(rows, QUERY).repartition(3))
    for k in (1, 4, 200):
        assert answers(retrieval.search(queries, index, k=k)) == answers(joined(queries, index, k))
    block = retrieval._arrays(index, 0)
    q = retrieval._scoped(queries, index, "product").join(index.scopes, "scope").filter("query_id is not null").withColumn("text", F.col("text").cast("binary"))
    batch = q.select("query_id", "scope", "allowed", "text").orderBy("query_id").toArrow().combine_chunks().to_batches()[0]
    whole = [x for b in block_scores.best_of(block, 4, 9)([batch]) for x in b.to_pylist()]
    monkeypatch.setattr(block_scores, "CELLS", 100)
    monkeypatch.setattr(block_scores, "MASKS", 1)
    parts = list(block_scores.best_of(block, 4, 9)([batch.slice(i, 1) for i in range(batch.num_rows)]))
    assert len(parts) > 10 and [x for b in parts for x in b.to_pylist()] == whole


def test_tokens_are_those_of_the_column(spark):
    texts = ["A-b_C 9é1", "Kelvin İstanbul ı ſ ß", "", "٣4", "x\x00y z", "🙂a🙂"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search_tokens(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == {t: [w.decode() for w in block_scores.tokens(t.encode())] for t in texts}


def test_timelines_are_found_at_digits_only(spark):
    """The engine's pattern finds what the plain one finds, and looks behind at digits only."""
    assert guardrails._TIMELINE.startswith("(?i)(?=")
    plain = unicode_pattern(guardrails.TIMELINE)
    texts = ["10 days", "a10 days", "_3 days é4 days ٣ days", "5days 6  Business\tDAYS 7 businessdays 8 daysx", "1.2 days-3 day", "12 34 days", "x\U0001d7d9 days \U0001d7d9 day", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for group in (0, 1):
        row = df.select(all_matches(F.col("t"), plain, group).alias("a"), all_matches(F.col("t"), guardrails._TIMELINE, group).alias("b")).collect()
        assert [r.a for r in row] == [r.b for r in row]
    assert sum(len(r.a) for r in row) == 8


def test_an_id_with_several_scopes(spark):
    """Its scores are those of the first scope; another one adds places without a score if it has too few with one."""
    rows = [("c#0", "c", "t", ["de"], "w1", 0), ("c#1", "c", "t", ["en"], "w1 w2", 1), ("c#2", "c", "t", ["en"], "w2", 2), *[(f"c#{i}", "c", "t", ["es"], "w9", i) for i in range(3, 9)]]
    index = retrieval.build_index(materialize(spark.createDataFrame(rows, CHUNK).repartition(1)))
    for query in (7, None):
        asked = spark.createDataFrame([(query, "w1", "de"), (query, "w2", "en"), (query, "w1", "de")], QUERY).coalesce(1)
        for k, want in ((1, ["c#0"]), (3, ["c#0", "c#1", "c#2"]), (4, ["c#0", "c#1", "c#2"]), (2, ["c#0"])):
            got = retrieval.search(asked, index, k=k).orderBy("rank").collect()
            assert [r.id for r in got] == want and got[0].score > 0 and all(r.score == 0 for r in got[1:])
