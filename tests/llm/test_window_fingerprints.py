import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textroute.llm import decontamination as dc
from textroute.llm import window_fingerprints as wf

LONG = 1 << 64


def signed(x):
    return x - LONG if x >> 63 else x


def test_fingerprint_is_the_majority_of_numbered_copies(spark):
    rng = random.Random(5)
    bags = [[signed(rng.randrange(LONG)) for _ in range(n)] for n in (0, 1, 2, 9, 60)]
    bags += [[7] * 12, [7, 7, 8, -1, -1, -1], bags[3] * 3]
    frame = spark.createDataFrame([(i, sorted(b)) for i, b in enumerate(bags)], "id int, bag array<long>")
    got = {r.id: r.code for r in frame.select("id", wf.fingerprint(F.col("bag")).alias("code")).collect()}
    pairs = [(i, h, n) for i, b in enumerate(bags) for h, m in Counter(b).items() for n in range(1, m + 1)]
    hashed = spark.createDataFrame(pairs, "id int, h long, n int").select("id", F.xxhash64("h", "n").alias("x")).collect()
    for i, b in enumerate(bags):
        codes = [r.x % LONG for r in hashed if r.id == i]
        assert len(codes) == len(b)
        assert got[i] == signed(sum(1 << bit for bit in range(64) if 2 * sum(c >> bit & 1 for c in codes) > len(b)))


@pytest.mark.parametrize("bits", [0, 3, 25, 35, 52])
def test_index_finds_every_pair_within_the_radius_once(spark, bits):
    rng = random.Random(bits)
    items = [rng.randrange(LONG) for _ in range(40)] + [0, LONG - 1]
    codes = [i ^ sum(1 << b for b in rng.sample(range(64), min(64, max(0, bits + rng.randint(-3, 2))))) for i in items for _ in range(12)] + items
    blocks = wf.block_count(bits)
    left = spark.createDataFrame([(signed(c),) for c in set(codes)], "code long")
    right = spark.createDataFrame([(signed(i),) for i in items], "item_code long")
    found = (left.select("code", F.inline(wf.looked_up(F.col("code"), blocks)))
             .join(right.select("item_code", F.inline(wf.indexed(F.col("item_code"), blocks))), ["block", "value"])
             .filter((wf.distance(F.col("code"), F.col("item_code")) <= bits)
                     & (F.col("block") == wf.first_block(F.col("code"), F.col("item_code"), blocks))))
    got = Counter((r.code, r.item_code) for r in found.collect())
    want = {(signed(c), signed(i)) for c in set(codes) for i in items if (c ^ i).bit_count() <= bits}
    assert set(got) == want and set(got.values()) == {1}


def test_radius_follows_the_threshold():
    assert [wf.radius(t) for t in (1.0, 0.8, 0.5)] == [0, 25, 35]
    assert wf.radius(0.01) <= 64 and wf.block_count(25) == 13


def test_similar_bags_lie_within_the_radius(spark):
    """Bags of similarity 0.8 whose difference is spread, or all in copies of one shingle."""
    rng = random.Random(8)
    new = lambda n: [signed(rng.randrange(LONG)) for _ in range(n)]
    rows = []
    for i in range(3000):
        shared, a, b = new(8 * (1 + i % 9)), new(1 + i % 9), new(1 + i % 9)
        if i % 2:
            a, b = a[:1] * len(a), b[:1] * len(b)
        rows.append((sorted(shared + a), sorted(shared + b)))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    far = frame.select(wf.distance(wf.fingerprint(F.col("a")), wf.fingerprint(F.col("b"))).alias("d"),
                       dc.similarity(F.col("a"), F.col("b")).alias("s")).agg(F.max("d"), F.min("s")).first()
    assert far[0] <= wf.radius(0.8) and far[1] == 0.8


def test_one_item_repeated_all_through_a_long_document(spark):
    """Rows stay as large as a few windows, however often the item is repeated."""
    item = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(item * 160))], "doc_id long, text string")
    got = dc.contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.start) for r in got] == [(1, 7, 1.0, 0)]
