"""Terms counted task by task: the same as a count of each record in plain Python, whatever the ids and characters."""
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from textroute.operators import features

# More characters than have a number of their own, a null character, a character beyond the basic plane.
MANY = " ".join(chr(0x4E00 + 7 * i) + chr(0x4E03 + 5 * i) for i in range(1500))
ROWS = [(1, "the card the card"), (2, None), (1, "the fee é"), (None, "card fee"), (None, "fee"), (3, MANY), (4, MANY[:300] + " a\0b 😀x the"),
        (5, ""), (6, "the the"), (6, "the"), *[(10 + i, f"the fee {i} {chr(0x4E00 + i)}") for i in range(700)]]


def plain(block):
    """Counts per record; the rows of an id are one record and pairs stay within a row."""
    found = defaultdict(Counter)
    for i, text in ROWS:
        tokens = (text or "").lower().split()
        if block == "char":
            for w in tokens:
                found[i].update(f" {w} "[k:k + n] for n in (3, 4, 5) for k in range(len(w) + 3 - n))
        else:
            import regex
            tokens = regex.findall(r"[\p{L}\p{N}_]{2,}", (text or "").lower())
            found[i].update([*tokens, *map(" ".join, zip(tokens, tokens[1:]))])
    return found


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "complaint_id long, narrative string")


def test_counts_and_frequencies(df):
    counts, frequencies = defaultdict(Counter), {}
    for r in features.term_counts(df).collect():
        assert r["term"] not in counts[r["block"], r["complaint_id"]]
        counts[r["block"], r["complaint_id"]][r["term"]] = r["tf"]
    for r in features.text_frequencies(df).collect():
        frequencies[r["block"], r["term"]] = r["df"], r["total_tf"]
    expected = Counter(), Counter()
    for block in ("word", "char"):
        for i, c in plain(block).items():
            assert counts[block, i] == c
            expected[0].update((block, t) for t in c)
            expected[1].update({(block, t): n for t, n in c.items()})
    assert frequencies == {k: (expected[0][k], expected[1][k]) for k in expected[0]}


def test_values_do_not_differ_from_the_joined_form(df):
    vocab = features.with_idf(features.frequent_terms(features.text_frequencies(df), {"word": 2, "char": 2}), len(ROWS))
    told = {tuple(r)[:3]: r["value"] for r in features.text_tfidf(df, vocab).collect()}
    joined = {tuple(r)[:3]: r["value"] for r in features.tfidf(features.term_counts(df), vocab).collect()}
    assert told.keys() == joined.keys() and all(told[k] == pytest.approx(joined[k]) for k in told)


def test_frequencies_hold_no_row_per_record_and_term(df):
    """One exchange brings texts together, the other one adds up what tasks have counted."""
    plan = features.text_frequencies(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan


def test_a_full_memory_starts_anew():
    coder = features.Words()
    _, codes = coder.codes(pa.array([["aa", "bb", "cc"]]))
    new, again = features.renewed(coder, codes[1:])
    assert new.decode(again).to_pylist() == coder.decode(codes[1:]).to_pylist() == ["bb", "cc", "aa bb", "bb cc"]
    grams = features.Grams()
    _, codes = grams.codes(pa.array([MANY]))
    new, again = features.renewed(grams, codes[-5:])
    assert grams.odd and new.decode(again).to_pylist() == grams.decode(codes[-5:]).to_pylist()


@pytest.mark.parametrize("cap", [3, 8, 20, 60, 1000])
@pytest.mark.parametrize("paired", [1 << 20, 2])
def test_pairs_of_rare_words_are_left_out_without_a_change(spark, monkeypatch, cap, paired):
    """Counting only pairs of frequent words gives what counting all of them gives, ties and repeated ids included."""
    monkeypatch.setattr(features, "PAIRED", paired)
    rnd = random.Random(cap)
    names = ["ab", "abc", "b", "zz", "yy x", "été", "ab ab", "q1", "mm nn", "kk"]
    rows = [(i // 2, " ".join(rnd.choices(names, [9, 7, 5, 3, 3, 2, 2, 1, 1, 1], k=rnd.randint(0, 9)))) for i in range(60)] + [(None, "ab zz"), (7, None)]
    df = spark.createDataFrame(rows, "complaint_id long, narrative string")
    cuts = {"min_df": {"word": 2, "char": 2}, "max_features": {"word": cap, "char": cap}}
    whole = features.frequent_terms(features.text_frequencies(df), **cuts)
    assert sorted(map(tuple, features.text_vocabulary(df, **cuts).collect())) == sorted(map(tuple, whole.collect()))
