import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textroute.llm import near_duplicates as nd
from textroute.llm.components import connected_components

DOCS = "doc_id long, text string, fp string, row string"


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@given(st.text(alphabet="abAB \t\x0b\x1c é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_majority_of_the_shingles(text):
    assert nd.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_fingerprint_counts_long_texts_in_blocks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = nd.fingerprint(text)
    monkeypatch.setattr(nd, "CHUNK", 64)
    assert nd.fingerprint(text) == whole


@pytest.mark.parametrize("family", [1, 4, 512])
def test_components_equal_all_pairs(spark, family):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(14)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    docs = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in nd.components(docs, family).collect()}
    assert [got[f] for f in signed] == brute_components(fps)


def test_exploded_rows_are_not_broadcast(spark):
    """Spark takes 64 rows a fingerprint for one, so it would broadcast all of them."""
    fps = spark.range(100).selectExpr("id as fp")
    sigs = nd.signatures(fps)
    hot = sigs.select("seg", "bit", "rest").limit(1)
    for edges in (nd._plain_links(sigs, hot), nd._family_links(sigs, hot)):
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "Inner" in line]


def test_all_rows_of_odd_input(spark):
    rows = [(7, "a b c d", "x", None), (3, "A  b c D", "x", None), (9, None, None, None), (4, "", None, None), (None, "only this", "", ""),
            (3, "A  b c D", "x", None), (5, " \n ", None, None), (8, "w " * 60000, None, None)]
    out = nd.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (3, 3), (9, 4), (4, 4), (5, 4), (None, None), (8, 8)], key=str)
    zero = [r.fingerprint for r in out.filter("doc_id = 4").collect()]
    assert zero == ["0" * 16]


def test_one_document_of_each_component_stays(spark):
    rows = [(7, "a b c d", "x", "r"), (3, "a b c d", "y", None), (3, "a b c d", "y", None), (9, None, None, None),
            (None, "first without id", "", ""), (None, "second one without id", "", "")]
    df = spark.createDataFrame(rows, DOCS)
    kept = nd.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.fp) for r in kept.collect()), key=str) == sorted([(3, "y"), (9, None), (None, ""), (None, "")], key=str)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert nd.keep_first(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_hubs_and_nulls(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in texts]
    roots = brute_components(fps)
    want = [(r.doc_id, f"{f:016x}", texts[root].doc_id) for r, f, root in zip(texts, fps, roots, strict=True)]
    assert [tuple(r) for r in nd.op7(spark, sf_dir).orderBy("doc_id").collect()] == want
