import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textroute.llm import suffix_tree as st

SCHEMA = "doc_id long, text string, learn boolean, train string, block string"


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")


def tokens(text):
    return [w for w in words(text) if w] + [None]


def plain(rows, depth):
    """Scores of `(doc_id, text, learn)` by dictionaries of whole contexts."""
    followed = defaultdict(Counter)
    for _, text, learn in rows:
        seq = tokens(text)
        for i, w in enumerate(seq if learn else []):
            for d in range(min(i, depth) + 1):
                followed[tuple(seq[i - d:i])][w] += 1
    known = followed[()]
    n, v = known.total(), len(known)
    add_one = lambda w: (known[w] + 1) / (n + v + 1)

    def stays(s):
        c = followed[s]
        suffix = lambda w: add_one(w) if len(s) == 1 else followed[s[1:]][w] / followed[s[1:]].total()
        return c.total() > 1 and sum(k * math.log(k / c.total() / suffix(w)) for w, k in c.items()) >= math.log(n + v + 1)

    def p(w, s):
        if not s:
            return add_one(w)
        c = followed[s]
        return (c[w] + len(c) * p(w, s[1:])) / (c.total() + len(c))
    out = {}
    for doc, text, _ in rows:
        seq, total = tokens(text), 0.0
        for i, w in enumerate(seq):
            s = next(tuple(seq[i - d:i]) for d in range(min(i, depth), -1, -1) if d == 0 or tuple(seq[i - d:i]) in followed and stays(tuple(seq[i - d:i])))
            total += math.log10(p(w, s))
        out[doc] = (len(seq), sum(known[w] > 0 for w in seq), sum(math.log10(add_one(w)) for w in seq), total)
    return out, n


def run(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    scored, n = st.score(df, F.col("learn"), **how)
    return {r.doc_id: tuple(r)[1:] for r in scored.collect()}, n


def sentences(rng, n):
    """Texts of a small grammar in which the word before last matters, with noise."""
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(0, 12)):
            a = rng.choice(["red", "blue", "The", "\ta"])
            text += [a, b := rng.choice(["cat", "dog", "cow"]), "ran" if (a == "red") == (b == "cat") else "sat", rng.choice("abcdefgh")]
        out.append((i, " ".join(text) if i % 17 else None, rng.random() < .7))
    return out


@pytest.mark.parametrize(("depth", "block"), [(2, 10_000), (2, 40), (3, 100), (1, 7)])
def test_equals_whole_contexts(spark, depth, block):
    rows = sentences(random.Random(depth), 120)
    got, n = run(spark, rows, depth=depth, block=block)
    want, m = plain(rows, depth)
    assert n == m and got.keys() == want.keys()
    for doc in want:
        assert got[doc] == pytest.approx(want[doc], rel=1e-9), doc


def test_a_hot_context_is_dealt_to_several_buckets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"the {rng.randrange(400)}" for _ in range(50)), True) for i in range(60)]
    got, _ = run(spark, rows, block=200)
    want, _ = plain(rows, 2)
    assert all(got[d] == pytest.approx(want[d], rel=1e-9) for d in want)
    tokens_of = np.concatenate([st.word_hashes(t) for _, t, _ in rows])
    context = np.roll(tokens_of, 1)
    live = context == st.word_hashes("the")[0]
    asked = st.ask(context, tokens_of >> np.uint64(16), live, live, live, np.zeros(len(live)), np.full(len(live), 15, np.uint64), 3)
    assert len(set(asked.bucket)) > 4 and asked.sizes.max() < 0.5 * asked.sizes.sum() and asked.hot.all()


def test_words_in_any_layout_score_alike(spark):
    rows = sentences(random.Random(9), 80)
    one, _ = run(spark, rows, parts=1)
    many, _ = run(spark, rows, parts=4, block=30)
    assert all(one[d] == pytest.approx(many[d], rel=1e-12) for d in one)


def test_probabilities_of_a_kept_context_add_up_to_one(spark):
    """Over all known words and one unknown one."""
    base = [(i, "x y z", True) for i in range(30)] + [(100 + i, f"w{i} q", True) for i in range(20)]
    vocabulary = sorted({w for _, t, _ in base for w in t.split()})
    probes = [(1000 + i, f"x y {w}", False) for i, w in enumerate([*vocabulary, "unseen"])] + [(2000, "x y", False)]
    got, n = run(spark, base + probes)
    bare = got[2000][3]
    want, _ = plain(base + probes, 2)
    end_after_y = want[2000][3]
    assert bare == pytest.approx(end_after_y)
    prefix = plain(base + [(5, "x y", False)], 2)[0][5][3]
    assert prefix == pytest.approx(bare)
    assert got[1000 + vocabulary.index("z")][3] > max(got[1000 + i][3] for i, w in enumerate(vocabulary) if w != "z")


def test_edges(spark):
    assert run(spark, []) == ({}, 0)
    got, n = run(spark, [(1, None, False), (2, "a b", False), (None, "a", None)])
    assert n == 0 and got == {1: (1, 0, 0.0, 0.0), 2: (3, 0, 0.0, 0.0), None: (2, 0, 0.0, 0.0)}
    long = "word other " * 30_000
    rows = [(1, long, True), (1, long, True), (2, "", True), (3, "\x1cé É", False)]
    got, n = run(spark, rows, block=1000)
    assert n == 120_003 and got[3][0] == 3 and got[2][0] == 1 and got[1][3] > got[1][2]


def test_packed_arrays_come_back():
    for values in (np.arange(5, dtype=np.uint64) * 10**15, np.zeros(0, np.uint32), np.array([1.5, -2], np.float32)):
        assert (st.unpack(st.pack(values), values.dtype) == values).all()
