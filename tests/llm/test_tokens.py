import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textroute.llm import chunk_bpe as cb
from textroute.llm import token_files as tf
from textroute.llm.word_memo import BlankCut, gathered, slices

BYTE, WORD = public_tokenizers.path(tf.TOKENIZER), public_tokenizers.path(cb.TOKENIZER)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\nb c", "it's  'S don't", "x<|endoftext|>y z", "<|startoftext|> b", "<|endof text|>",
       "café ́x", "İstanbul ǅ Σας ΟΔΟΣ", "a b  c", "a\x1cb \x1c c", "a\x85b \x85", "  x　y", "zero​width ​ x",
       "漢字かな交じり文" * 5, "😀 👨‍👩‍👧 x", "1234 5678.9", "...!!! ???", "ẞẞß ſt", "Ⱥ ⱥ Ƀ", "a\tb\rc\x0bd\x0ce", "\x00 \x01", "_ __x", "x" * 3000, " ".join(["word"] * 3000)]
alphabet = st.sampled_from(list("aAbeE'stdlmrv \n\t.,1é́ \x1c\x85漢<|>ßİΣ​") + ["  ", "<|endoftext|>", "'ll", "the ", " in"])
texts = st.lists(alphabet, max_size=40).map("".join)


@pytest.fixture(scope="module")
def encoders():
    return {"byte": (Tokenizer.from_file(BYTE), BlankCut(BYTE)), "word": (Tokenizer.from_file(WORD), cb.ChunkCut(WORD))}


def ids_of(encoder, items):
    return [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(items)]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_are_the_librarys(encoders, kind, monkeypatch):
    monkeypatch.setattr(cb, "MASK", 7)
    library, encoder = encoders[kind]
    want = [library.encode(t, add_special_tokens=False).ids for t in ODD]
    assert ids_of(encoder, ODD) == want
    assert ids_of(encoder, ODD) == want  # from memory

    @given(st.lists(texts, max_size=4))
    @settings(max_examples=600, deadline=None)
    def check(items):
        assert ids_of(encoder, items) == [library.encode(t, add_special_tokens=False).ids for t in items]
    check()
    if kind == "word":
        assert encoder.stats["anew"] == 0 < encoder.stats["joins"]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_a_full_memo_is_emptied(kind):
    rng = random.Random(1)
    items = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(200)) for _ in range(30)]
    small = BlankCut(BYTE, 50) if kind == "byte" else cb.ChunkCut(WORD, 50, 500)
    library = Tokenizer.from_file(BYTE if kind == "byte" else WORD)
    for t in items:
        assert ids_of(small, [t, t]) == [library.encode(t, add_special_tokens=False).ids] * 2


def test_known_pieces_cost_no_python_objects():
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    text = "\n".join(" ".join(rng.choices(names, k=1000)) for _ in range(200))
    encoder = BlankCut(BYTE)
    want = encoder.encode([text])
    tracemalloc.start()
    got = encoder.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and ids_of(encoder, [text])[0] == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert peak < 8 * len(text)  # as strings in a list the pieces alone take 12 times the text


def test_blanks_beside_line_breaks_and_texts_of_one_piece():
    library, encoder = Tokenizer.from_file(BYTE), BlankCut(BYTE)
    items = ["b \nb", "b", "\nb b", "b \n", "b\nb b\n", " b", "b  b", "b\n\nb \nb", "\n", " \n b", "b\t b", "b \tb", "b" * 5000, "\n" * 3, "b b\nb"]
    for _ in range(2):
        assert ids_of(encoder, items) == [library.encode(t, add_special_tokens=False).ids for t in items]
        assert [ids_of(encoder, [t])[0] for t in reversed(items)] == ids_of(encoder, items)[::-1]
    assert encoder.encode([]) == []
    assert max(map(len, encoder.words.to_pylist())) < 300  # a long piece is forgotten


def test_small_batches_are_put_together():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(i, i + 4))}) for i in range(0, 28, 4)]
    assert [t["x"].to_pylist() for t in gathered(batches, 64)] == [list(range(8)), list(range(8, 16)), list(range(16, 24)), list(range(24, 28))]
    assert list(gathered([], 64)) == []


def test_pieces_are_encoded_alone_where_cuts_fail():
    library, encoder = Tokenizer.from_file(BYTE), BlankCut(BYTE)
    encoder.width = encoder.width + 1
    assert ids_of(encoder, ODD) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_chunks_are_cut_by_content_and_reused():
    rng = random.Random(2)
    passage = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(2000))
    a, b = "one start " + passage, "quite another beginning here " + passage
    assert "".join(a[x:y] for x, y in zip([0, *cb.cuts(a)], cb.cuts(a))) == a
    shared = set(len(a) - c for c in cb.cuts(a)) & set(len(b) - c for c in cb.cuts(b))
    assert len(shared) >= len(cb.cuts(a)) - 3
    encoder = cb.ChunkCut(WORD)
    encoder.encode([a, b])
    assert encoder.stats["encoded"] < 0.6 * encoder.stats["asked"]
    assert max(np.diff([0, *cb.cuts("x" * 100_000)])) <= cb.LONGEST


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
@settings(max_examples=300, deadline=None)
def test_codes_are_read_back(values):
    control, data = tf.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert tf.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)).tolist() == values


def test_blocks_are_read_back():
    lengths, ranks = np.array([2, 0, 3]), np.array([1, 500, 70000, 0, 2**31], np.uint32)
    block = tf.write_block(77, [5, None, -3], lengths, ranks)
    first, ids, n, got = tf.read_block(block)
    assert (first, ids, n.tolist(), got.tolist()) == (77, [5, None, -3], [2, 0, 3], ranks.tolist())
    assert list(slices(["aaa", "b", "cccccc", "", "d"], 4)) == [(0, 2), (2, 3), (3, 5)]
    with pytest.raises(ValueError, match="block"):
        tf.read_block(b"x" * 100)


DOCS = "doc_id long, text string, ids string, part string"


def test_files_hold_all_documents_in_order(spark, tmp_path):
    rows = [(5, "b a", "", ""), (2, None, None, None), (None, "no id", "", ""), (9, "", "", ""), (5, "b a", "", ""), (2**53 + 1, "word " * 30000, "", "")]
    rows += [(100 + i, t, "", "") for i, t in enumerate(ODD)]
    tf.write_tokens(spark.createDataFrame(rows, DOCS), str(tmp_path), BYTE)
    got = sorted(tf.read_tokens(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(BYTE), 0
    by_id = {}
    for d, t, *_ in rows:
        by_id.setdefault(d, set()).add(tuple(library.encode(t or "", add_special_tokens=False).ids + [2]))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    for r in got:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert ids in by_id[r.doc_id] and r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    ranks = [r.id for r in spark.read.parquet(f"{tmp_path}/ranks").orderBy("rank").collect()]
    assert ranks[0] == library.encode(" word", add_special_tokens=False).ids[0]


def test_ranks_follow_the_counts_of_all_partitions(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("the of and to in is that for it on".split(), k=i % 40)), "", "") for i in range(300)]
    tf.write_tokens(spark.createDataFrame(rows, DOCS).repartition(3), str(tmp_path), BYTE)
    library = Tokenizer.from_file(BYTE)
    counts = Counter(i for _, t, *_ in rows for i in [*library.encode(t, add_special_tokens=False).ids, tf.END_ID])
    got = [r.id for r in spark.read.parquet(f"{tmp_path}/ranks").orderBy("rank").collect()]
    assert got == sorted(counts, key=lambda i: (-counts[i], i))


def test_digests_of_odd_rows(spark):
    rows = [(1, None, "", ""), (None, "Hello World", "", ""), (1, "x", "", ""), (1, "x", "", "")]
    got = sorted((tuple(r) for r in cb.digests(spark.createDataFrame(rows, DOCS), WORD).collect()), key=str)
    library = Tokenizer.from_file(WORD)

    def want(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
    assert got == sorted((want(d, t) for d, t, *_ in rows), key=str)
    assert cb.encode(spark.createDataFrame(rows[2:3], DOCS), WORD).first().ids == library.encode("x", add_special_tokens=False).ids


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    assert cb.digests(docs, WORD).count() == cb.encode(docs, WORD).count() == 0
    tf.write_tokens(docs, str(tmp_path), BYTE)
    assert tf.read_tokens(spark, str(tmp_path)).count() == 0


def test_queries_equal_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    byte, word, at = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), 0
    four, nine = ({r.doc_id: r for r in q(spark, sf_dir).collect()} for q in (tf.op4, cb.op9))
    for d in docs:
        ids = byte.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert tuple(four[d.doc_id]) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        ids = word.encode(d.text or "", add_special_tokens=False).ids
        assert nine[d.doc_id].n_tokens == len(ids)
        assert nine[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert nine[d.doc_id].decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
