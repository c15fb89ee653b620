import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontamination import brute
from tests.llm.test_near_duplicates import brute_components, plain_fingerprint
from tests.llm.test_toxicity import corpus
from textroute.llm import chunk_bpe, language_id, toxicity
from textroute.llm.queries import QUERIES


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def small_tables(spark, folder, rows):
    rng = random.Random(9)
    item = " ".join(rng.choices([f"item{i}" for i in range(60)], k=30))
    docs = [(i, t, "en", "s", len(t), "more") for i, t, _ in rows]
    if rows:
        docs += [(1001, rows[1][1], "en", "s", 1, None), (1001, rows[1][1], "en", "s", 1, None), (1002, rows[2][1].upper(), None, None, None, None),
                 (1003, f"{rows[5][1]} {item}", "en", "s", 1, ""), (1004, None, "en", "s", 1, ""), (1005, "12 34", "en", "s", 1, ""),
                 (None, "a text without an id " * 8, "en", "s", 1, "")]
    write(spark, folder, "documents", docs, "doc_id long, text string, lang string, source string, n_chars int, toxic string")
    write(spark, folder, "labels", [(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", [(7, item)], "item_id long, text string")
    return docs, item


def test_equals_a_plain_version(spark, tmp_path):
    docs, item = small_tables(spark, tmp_path, corpus(160))
    model = toxicity.train(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")))
    left = [(d, t or "") for d, t, *_ in docs if toxicity.score(t, model) < toxicity.THRESHOLD]
    assert 30 <= len(docs) - len(left) <= 50
    left = [(d, t) for d, t in left if language_id.vector(t) is not None]
    roots = brute_components([plain_fingerprint(t) for _, t in left])
    groups = {}
    for (d, t), root in zip(left, roots, strict=True):
        groups.setdefault(root, []).append((d is None, d or 0, t))
    left = [(None if a else d, t) for a, d, t in map(min, groups.values())]
    found = {d for d, _ in brute(left, [(7, item)])}
    left = [(d, t) for d, t in left if d not in found]
    library = Tokenizer.from_file(public_tokenizers.path(chunk_bpe.TOKENIZER))
    want = {(d, hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for d, t in left}
    got = [(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    ids = {d for d, _ in got}
    assert ids.isdisjoint({1001, 1002, 1003, 1004, 1005}) and {1, 2, None} <= ids


def test_stages_keep_the_columns(spark, tmp_path):
    small_tables(spark, tmp_path, corpus(40))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema


def test_empty_tables(spark, tmp_path):
    small_tables(spark, tmp_path, [])
    assert QUERIES["pipeline"](spark, str(tmp_path)).count() == 0
