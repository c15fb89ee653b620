import random
import re
from collections import Counter

import pytest

from textroute.llm import decontamination as dc

DOCS = "doc_id long, text string, item_id string, w string"
ITEMS = "item_id long, text string, doc_id string"


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bag(words, k):
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    """Every window of every item's length against the item."""
    out = {}
    for d, text in docs:
        words = plain_words(text)
        for i, item in items:
            target = plain_words(item)
            n, k = len(target), min(5, len(target))
            if not n or not words:
                continue
            want = bag(target, k)
            for start in range(max(1, len(words) - n + 1)):
                got = bag(words[start:start + n], k)
                if (union := sum((got | want).values())) and (s := sum((got & want).values()) / union) >= 0.8:
                    out[d, i] = max(out.get((d, i), (0, 0)), (s, -start))
    return {k: (s, -b) for k, (s, b) in out.items()}


def found(spark, docs, items):
    out = dc.contaminated(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS),
                          spark.createDataFrame([(*i, "z") for i in items], ITEMS))
    return {(r.doc_id, r.item_id): (r.similarity, r.start) for r in out.collect()}


def test_equals_every_window_against_every_item(spark):
    rng = random.Random(3)
    vocabulary = [a + b for a in "abcdefgh" for b in "mnopqr"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(5, 70))) for i in range(40)] + [(100, "one two"), (101, "la la la la la la la la la"), (102, ""), (103, None)]
    docs = []
    for d in range(150):
        words = text(rng.randint(0, 150)).split()
        item = plain_words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 2)):  # words replaced, dropped or put in
            at = rng.randrange(len(item) + 1)
            item[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        at = rng.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + item + words[at:]).title().replace(" ", rng.choice([" ", ", ", "\n"]))))
    docs += [(900, None), (901, ""), (902, "?!"), (903, items[0][1]), (904, "x " * 2000 + items[1][1])]
    got, texts, of_item = found(spark, docs, items), dict(docs), dict(items)
    assert {k: s for k, (s, _) in got.items()} == {k: s for k, (s, _) in brute(docs, items).items()}
    for (d, i), (s, start) in got.items():
        target = plain_words(of_item[i])
        k = min(5, len(target))
        a, b = bag(target, k), bag(plain_words(texts[d])[start:start + len(target)], k)
        assert s == sum((a & b).values()) / sum((a | b).values())


def test_window_need_not_be_aligned(spark):
    """Bags ignore order: halves and sentences swapped, rotated items, and items of one repeated word."""
    rng = random.Random(11)
    docs, items, d = [], [], 0
    for i in range(12):
        n = rng.randint(30, 80)
        item = [f"i{i}w{j}" for j in range(n)]
        items.append((i, " ".join(item)))
        pad = lambda: [f"p{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 100]))]
        for cut in (n // 2, n // 3, 7):
            docs.append((d := d + 1, " ".join(pad() + item[cut:] + item[:cut] + pad())))
        a, b, c = item[:n // 3], item[n // 3:2 * n // 3], item[2 * n // 3:]
        docs.append((d := d + 1, " ".join(pad() + c + a + b + pad())))
        docs.append((d := d + 1, " ".join(pad() + b + a + item[:2] + c + pad())))
    items.append((99, "la " * 20 + "di da"))
    docs += [(900, "x di da " + "la " * 20), (901, "la " * 60), (902, "la " * 18 + "di da la la")]
    got, want = found(spark, docs, items), brute(docs, items)
    assert got == want and len(want) > 36


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_replaced_tails_at_any_threshold(spark, threshold):
    """Few shingles break when the last words are replaced, but many bits of a fingerprint of the words."""
    rng = random.Random(17)
    docs, items, want = [], [], {}
    for i in range(600):
        n = rng.choice([22, 60, 100])
        item = [f"i{i}w{j}" for j in range(n)]
        tail = n // 10 if threshold == 0.8 else n // 4
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(["before"] * 3 + item[:n - tail] + [f"d{i}w{j}" for j in range(tail)])))
        shared = n - tail - 4
        want[i, i] = shared / (2 * (n - 4) - shared)
    assert min(want.values()) >= threshold
    out = dc.contaminated(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS),
                          spark.createDataFrame([(*i, "z") for i in items], ITEMS), threshold=threshold)
    assert {(r.doc_id, r.item_id): r.similarity for r in out.collect()} == want


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"a {item} b"), (1, f"a {item} b"), (1, f"x y {item}"), (None, item), (2, "a b")]
    got = dc.contaminated(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(7, item, ""), (7, item, "")], ITEMS))
    assert sorted(((r.doc_id, r.item_id, r.similarity, r.start) for r in got.collect()), key=str) == [(1, 7, 1.0, 1), (1, 7, 1.0, 2), (None, 7, 1.0, 0)]
    left = dc.decontaminate(spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, found_id string, found_hash string"),
                            spark.createDataFrame([(7, item, "")], ITEMS))
    assert [tuple(r) for r in left.collect()] == [(2, "a b", "x", "y")]


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert found(spark, docs, items) == {}


def test_query_equals_every_window(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = {}
    for d, text in docs:  # items that share a shingle; the others can't reach the threshold
        grams = set(bag(plain_words(text), 5))
        want |= brute([(d, text)], [i for i in items if grams & set(bag(plain_words(i[1]), 5))])
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.op8(spark, sf_dir).collect()}
    assert got == {k: s for k, (s, _) in want.items()} and got
