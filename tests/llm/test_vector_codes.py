import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textroute.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, parts string"


def brute(rows, rounds=vc.ROUNDS):
    """Codes and errors by evaluating every distance in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // vc.PARTS
    cut = [[tuple(math.floor(4096 * float(np.float32(x))) for x in v[p * size:(p + 1) * size]) for p in range(vc.PARTS)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: kept[i][0])[:vc.ENTRIES]
    books = [[cut[i][p] for i in order] for p in range(vc.PARTS)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min((far(part, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(vc.PARTS):
            groups = {}
            for c in cut:
                groups.setdefault(best(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else e for j, e in enumerate(books[p])]
    found = [[best(c[p], books[p]) for p in range(vc.PARTS)] for c in cut]
    return [(kept[i][0], "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), kept[i][2]) for i, f in enumerate(found)], books


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    coded, books = vc.encode(df)
    return [tuple(r) for r in vc.with_label_error(coded).collect()], books


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_all_distances(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, .2), .25, -.5]) for _ in range(16)], rng.choice([0, 0, 0, 1, None])) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(40)] + [(-5, None, 1), (-4, [math.nan] + [0.] * 15, 1), (-3, [None] * 16, 1), (-2, [math.inf] * 16, 1)]
    got, books = run(spark, rows)
    want, entries = brute(rows)
    assert sorted((i, c, e) for i, _, c, e, _ in got) == sorted((i, c, e) for i, c, e, _ in want)
    assert books.entries.tolist() == [list(map(list, b)) for b in entries]
    sums = {}
    for _, _, e, lab in want:
        sums[lab] = sums.get(lab, 0) + e
    assert all(total == sums[lab] for _, lab, _, _, total in got)


def test_pivots_spare_evaluations_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = centres[rng.integers(0, 16, 5000)] + rng.integers(-50, 50, (5000, 8))
    pivots = centres[vc.choose_pivots(centres)]
    index, best, evaluated = vc.nearest(parts, vc.distances(parts, pivots), pivots, centres)
    all_of = ((parts[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (index == all_of.argmin(axis=1)).all() and (best == all_of.min(axis=1)).all()
    assert evaluated < 0.25 * all_of.size


def test_ties_go_to_the_lower_index():
    entries = np.array([[4, 0], [0, 0], [2, 2], [2, 2]])
    parts = np.array([[2, 0], [2, 2], [0, 0]])
    index, _, _ = vc.nearest(parts, vc.distances(parts, entries[:1]), entries[:1], entries)
    assert index.tolist() == [0, 2, 1]


def test_large_components_count_as_the_limit(spark):
    rows = [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [0.] * 8, 0)]
    got, books = run(spark, rows)
    assert {(i, e) for i, _, _, e, _ in got} == {(1, 0), (2, 0), (3, 0)}
    assert abs(books.entries).max() == vc.component_limit(1)
    assert (2 * vc.component_limit(512)) ** 2 * 512 < 2 ** 63 and (2 * vc.component_limit(1)) ** 2 < 2 ** 63


def test_few_rows_other_lengths_repeats_and_null_ids(spark):
    rows = [(2, [.5] * 8, 1), (2, [.5] * 8, 1), (None, [.25] * 8, None), (3, [.1] * 7, None), (4, [], 2)]
    got, books = run(spark, rows)
    assert books.entries.shape == (8, 2, 1)
    assert sorted(got, key=str) == sorted([(2, 1, "00" * 8, 0, 0)] * 2 + [(None, None, "01" * 8, 0, 0), (3, None, None, None, 0), (4, 2, None, None, None)], key=str)


def test_empty_tables_and_uncuttable_vectors(spark):
    none, books = vc.encode(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["vec_id", "label", "code", "error"] and none.count() == 0 and books is None
    odd, books = vc.encode(spark.createDataFrame([(1, [1.] * 9, 0, "", "")], SCHEMA))
    assert [tuple(r) for r in odd.collect()] == [(1, 0, None, None)] and books is None
    nothing, books = vc.encode(spark.createDataFrame([(1, [], 0, "", ""), (2, [], 0, "", "")], SCHEMA))
    assert {(r.code, r.error) for r in nothing.collect()} == {(None, None)} and books is None


def test_pivot_distances_are_stored_with_the_parts(spark):
    df = spark.createDataFrame([(i, [i / 10] * 8, 0, "", "") for i in range(20)], SCHEMA)
    rows = vc.usable(df.select("vec_id", "label", F.col("embedding").alias("vector")))
    entries = np.arange(16).reshape(1, 16, 1).repeat(8, axis=0) * 409
    books = vc.Codebooks(entries, entries[:, :4])
    far = vc.with_pivots(rows, books, 8).filter("vec_id = 10").first()
    assert far.to_pivots[:4] == [4096 - 409 * j for j in range(4)] and far.parts == [4096] * 8
