"""BPE encoding that reuses content-defined chunks.

Texts are cut where a rolling hash of the last 16 characters has its low bits zero, so equal passages
are cut alike wherever they stand, and a worker encodes each chunk it meets once, however many
documents share it. A cut falls anywhere, mostly inside a word. Each join of two chunks is repaired: the
parts of the word around it are encoded again as a whole, together with the next whole word on either
side. If the ids of these words are those that the chunks have, the repair agrees with both chunks and
is complete; else it is widened to the whole text.

Within a chunk, the library sees each distinct word once per worker. White space of ASCII always ends a
word for this vocabulary, whatever follows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textroute.llm.registry import query, table
from textroute.llm.word_memo import PIECES, Pieces, shared, slices

TOKENIZER = "word_bpe_49k.json"
SUFFIX = "</w>"
#: A cut at one place in 512 on average; a cut is forced where this many characters lack one.
MASK = (1 << 9) - 1
LONGEST = 1 << 13
#: Characters of chunks that a worker remembers.
CHUNK_CHARS = 1 << 22
_BASE = np.uint32(0x9E3779B1)

_GAP = re.compile("[ \t\n\r\x0b\x0c]+")
#: White space that str.split knows besides.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LAST = re.compile("[^ \t\n\r\x0b\x0c]*\\Z")


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """For each character a hash of it and the 15 before it (fewer at the beginning)."""
    h = (codes + np.uint32(1)) * np.uint32(0x85EBCA6B)
    power = _BASE
    for step in (1, 2, 4, 8):
        later = h.copy()
        later[step:] += h[:-step] * power if step < len(h) else np.uint32(0)
        h, power = later, power * power
    return h ^ (h >> np.uint32(15))


def cuts(text: str) -> list[int]:
    """Where chunks end; the last one is the end of the text."""
    if not text:
        return []
    with np.errstate(over="ignore"):
        found = np.flatnonzero((rolling_hash(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")) & np.uint32(MASK)) == 0) + 1
    out, at = [], 0
    for end in [*found.tolist(), len(text)]:
        while end - at > LONGEST:
            at += LONGEST
            out.append(at)
        if end > at:
            out.append(end)
            at = end
    return out


def words(text: str) -> list[str]:
    return [w for w in _GAP.split(text) if w] if _OTHER_SPACE.search(text) else text.split()


class Chunk:
    """A chunk's whole words with their ids, and what is left of cut words at its ends.

    `head` and `tail` are empty if the chunk begins or ends with white space. A chunk without white space
    is all head.
    """

    __slots__ = ("head", "tail", "words", "ids", "solid")

    def __init__(self, text: str):
        gap = _GAP.search(text)
        self.solid = gap is None
        self.head = text if self.solid else text[:gap.start()]
        self.tail = "" if self.solid else _LAST.search(text)[0]
        self.words = [] if self.solid else words(text[len(self.head):len(text) - len(self.tail)])
        self.ids: list[bytes] = []


class ChunkCut(Pieces):
    """Encodes texts by chunks; `stats` counts chunks asked for and encoded, repaired joins and texts done anew."""

    def __init__(self, path: str, limit: int = PIECES, chunk_chars: int = CHUNK_CHARS):
        super().__init__(path, SUFFIX, limit)
        self.room, self.chars = chunk_chars, 0
        self.chunks: dict[str, Chunk] = {}
        self.stats = dict.fromkeys(("asked", "encoded", "joins", "anew"), 0)
        self.decimals = [str(i) for i in range(len(self.names))]

    def look_up(self, texts: list[str]) -> list[list[Chunk]]:
        """The chunks of each text, encoded where they are new to this worker."""
        self.turn()
        if self.chars > self.room:
            self.chunks.clear()
            self.chars = 0
        plans, new = [], {}
        for text in texts:
            ends = cuts(text)
            plans.append([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            new |= {part: None for part in plans[-1] if part not in self.chunks}
        self.stats["asked"] += sum(map(len, plans))
        self.stats["encoded"] += len(new)
        fresh = {part: Chunk(part) for part in new}
        seen = set().union(*(chunk.words for chunk in fresh.values()))
        self.memo.update(self.learn(self.unknown(seen)))
        for part, chunk in fresh.items():
            chunk.ids = list(map(self.memo.__getitem__, chunk.words))
            self.chars += len(part)
        self.chunks |= fresh
        return [[self.chunks[part] for part in parts] for parts in plans]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as bytes."""
        plans, repairs = [], {}
        for chunks in self.look_up(texts):
            plan, left, cut = [], None, ""  # ids of words, and joins (word before, cut word, word after)

            def join(right, plan=plan, left=None, cut=""):
                window = " ".join([*(left.words[-1:] if left else []), cut, *(right.words[:1] if right else [])])
                repairs[window] = b""
                plan.append((window, left.ids[-1:] if left else [], right.ids[:1] if right else []))
            for chunk in chunks:
                cut += chunk.head
                if chunk.solid:
                    continue
                if cut:
                    join(chunk, left=left, cut=cut)
                plan.append(chunk.ids)
                left, cut = chunk, chunk.tail
            if cut:
                join(None, left=left, cut=cut)
            plans.append(plan)
        self.stats["joins"] += len(repairs)
        repairs = dict(zip(repairs, self.whole(list(repairs)), strict=True))
        return [self.assemble(text, plan, repairs) for text, plan in zip(texts, plans, strict=True)]

    def assemble(self, text: str, plan: list, repairs: dict[str, bytes]) -> bytes:
        out: list[bytes] = []
        for part in plan:
            if isinstance(part, list):
                out += part
                continue
            window, before, after = part
            ids, first, last = repairs[window], b"".join(before), b"".join(after)
            if not ids.startswith(first) or not ids.endswith(last) or len(ids) < len(first) + len(last):
                self.stats["anew"] += 1
                return self.whole([text])[0]
            out.append(ids[len(first):len(ids) - len(last)])
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The library's decoding without a decoder: names joined by blanks."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _over_ids(path: str, schema: pa.Schema, columns):
    """A map over Arrow batches that hands `columns` the encoder and the ids of some texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(ChunkCut, path)
        for batch in batches:
            texts, doc_ids = [t or "" for t in batch["text"].to_pylist()], batch["doc_id"].to_pylist()
            for a, b in slices(texts):
                ids = [np.frombuffer(x, encoder.dtype) for x in encoder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([doc_ids[a:b], *columns(encoder, ids)], schema, strict=True)], schema=schema)
    return run


def _digests(encoder: ChunkCut, ids: list[np.ndarray]) -> list[list]:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return [[len(x) for x in ids], [sha(" ".join(map(encoder.decimals.__getitem__, x.tolist()))) for x in ids], [sha(encoder.decode(x)) for x in ids]]


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def encode(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, ids)` for each row of `df`; null and empty texts have no ids. No exchange; other columns are not read.

    Repeated rows and null ids are encoded like any other. A very long text is a batch of its own.
    """
    return _rows(df, doc_id, text).mapInArrow(_over_ids(tokenizer, IDS, lambda _, ids: [ids]), "doc_id long, ids array<int>")


def digests(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256)` for each row of `df`: ids as decimals, and decoded again."""
    return _rows(df, doc_id, text).mapInArrow(
        _over_ids(tokenizer, DIGESTS, _digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op9_chunk_reuse_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digests of each document's ids and of their decoding."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
