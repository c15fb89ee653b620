import numpy as np
import pytest
from pyspark.sql import functions as F

from textroute.llm import vector_tree as vt

ROWS = "vec_id long, embedding array<float>, label int, v string, leaf int"


def brute(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            scores = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "v", 2) for i, v in rows], ROWS)


def clustered(n, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[i % 12] + 0.3 * rng.normal(size=dims)).astype(np.float32)) for i in range(n)]


def search(spark, rows, k=20, **more):
    return found(vt.search(table(spark, rows), F.col("id") % 20 == 0, k, **more))


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(vt, "LEAF", 40)
    monkeypatch.setattr(vt, "BLOCK_BYTES", 8 * 8 * 30)  # leaves and queries in several blocks
    monkeypatch.setattr(vt, "QUERIES_AT_ONCE", 3)
    rows = clustered(2400)
    want, got = brute(rows), search(spark, rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    x = dict(rows)
    assert all(s == (x[q].astype(float) * x[i].astype(float)).sum() for q, near in got.items() for i, s in near)
    assert all(near == sorted(near, key=lambda p: (-p[1], p[0])) for near in got.values())


def test_all_leaves_are_opened_for_full_recall(spark, monkeypatch):
    monkeypatch.setattr(vt, "LEAF", 20)
    rows = clustered(400)
    assert search(spark, rows, recall=1.01) == brute(rows)


def test_copies_and_odd_rows(spark):
    rows = clustered(60) + [(i, np.ones(8, np.float32)) for i in range(1000, 1400)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] * 4), (2060, [float("nan")] * 8), (2080, [float("inf")] + [1.0] * 7), (2100, [1.0, 2.0]), (2120, []), (None, [9.0] * 8)]
    want = brute(rows)
    assert search(spark, rows + odd + rows[:30]) == want  # repeated rows count once
    assert [i for i, _ in want[1000]] == list(range(1001, 1021))


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_rows(spark, n):
    rows = clustered(n)
    assert search(spark, rows) == (brute(rows) if n > 1 else {})


def test_tree_holds_all_rows():
    x = np.array([v for _, v in clustered(1000)], float)
    tree = vt.build_tree(x, 30)
    leaf = vt.descend(x, tree)
    assert set(leaf) <= set(range(tree.leaves)) and 15 <= tree.leaves <= 120
    sizes = np.bincount(leaf, minlength=tree.leaves)
    order = vt.best_bins(x[0], tree, tree.leaves, sizes, 0)
    assert sorted(order) == list(range(tree.leaves))
    assert len(vt.best_bins(x[0], tree, 1, np.ones(tree.leaves), 5)) == 5
    assert vt.build_tree(np.ones((50, 3)), 10).leaves == 1


def test_bundles_are_bounded():
    assert vt.bundles(np.array([3, 4, 5, 20, 1, 9]), 10).tolist() == [0, 0, 1, 2, 3, 3]


def test_query_has_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows), found(vt.op6(spark, sf_dir))
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
