"""Registered queries do their whole job: no part of the input or of the method is left out."""
import os
from collections import defaultdict
from glob import glob

import numpy as np
import pytest

import __spark_entry__ as entry
from textroute.session import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_vector_search_asks_for_every_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (130, 4)).astype(float) + 0.5
    rows = [(3 * i + 1, v.tolist()) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["vector_search"](spark, str(tmp_path)).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    expected = {(rows[q][0], rank, rows[v][0]) for q in range(len(rows))
                for rank, v in enumerate(sorted(range(len(rows)), key=lambda v: (-scores[q, v], v))[:5], 1)}
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == expected and len(got) == 5 * len(rows)
    assert "% 100" not in entry.oracle_sql()["vector_search"]


def test_tfidf_has_words_and_characters(spark, tmp_path):
    texts = ["the card fee", "the card", "a fee on the card", "the the fee", None, "fee"]
    spark.createDataFrame([(i, t, "en", "s", 6) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    squares, terms = defaultdict(float), defaultdict(set)
    for r in entry.queries()["tfidf"](spark, str(tmp_path)).collect():
        squares[r["complaint_id"], r["block"]] += r["value"] ** 2
        terms[r["block"]].add(r["term"])
    assert terms["word"] == {"the", "card", "fee", "the card"}
    assert terms["char"] == set()  # no gram is in five records
    spark.createDataFrame([(i, t, "en", "s", 6) for i, t in enumerate(texts * 3)], DOCS).write.parquet(f"{tmp_path}/more/documents.parquet")
    for r in entry.queries()["tfidf"](spark, f"{tmp_path}/more").collect():
        squares["more", r["complaint_id"], r["block"]] += r["value"] ** 2
        terms[r["block"]].add(r["term"])
    assert {" fee ", "ard", " th", "card "} <= terms["char"] and not {"on ", "e c"} & terms["char"]
    assert {("more", 0, "word"), ("more", 0, "char"), ("more", 17, "char")} <= squares.keys()
    assert all(n == pytest.approx(1, abs=1e-4) for n in squares.values())
    assert "char_values" in entry.oracle_sql()["tfidf"]


def test_pages_have_no_second_file(spark, tmp_path):
    """One file a page: no checksum beside it, whose making costs as much as the page's."""
    spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(30)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob(f"{shared_folder(spark).removeprefix('file://')}/*/corpus-*"))
    got = entry.queries()["scan_corpus"](spark, str(tmp_path)).collect()
    assert len({r["raw"] for r in got}) == 30
    folder, = set(glob(f"{shared_folder(spark).removeprefix('file://')}/*/corpus-*")) - before
    names = [n for n in os.listdir(folder) if "part-" in n]
    assert len(names) == 30 and all(n.endswith(".txt") for n in names)
