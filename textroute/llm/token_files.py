"""Token ids in files: ids ranked by frequency, in byte-aligned codes with separate control bytes.

The more frequent an id in the whole corpus, the smaller its rank, and a rank takes as many bytes as
it needs, one to four. A control byte holds the sizes of four ranks, two bits each, lowest first. All
control bytes of a block stand before all rank bytes, so that a block is decoded without a loop over
ids: a table maps a control byte to four sizes, their running sum gives the places of the rank bytes.

A block holds some consecutive documents:

    magic "TKV1" | documents, ids, rank bytes: 3 x uint64 | first: uint64, ids before the block
    doc ids: int64 each | 1 for an id, 0 for null: uint8 each | ids per document: uint64 each
    control bytes: (ids + 3) // 4 | rank bytes

all little-endian. Blocks travel as a binary column of Parquet files, so that Spark's committers write
them once each whatever executor is lost, to any store Spark can reach. The folder `blocks/part=N`
holds the N-th range of ids, ordered by `first`; `ranks` holds the table of ids by rank.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textroute.llm.registry import query, table
from textroute.llm.word_memo import MANY_CHARS, BlankCut, gathered, shared, slices
from textroute.session import work_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"TKV1"
HEADER = struct.Struct("<4s4Q")
#: The four sizes that each control byte stands for.
SIZES = (1 + (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3)).astype(np.uint8)
#: How often a partition has each id it has.
TALLY = np.dtype([("id", "<u4"), ("n", "<i8")])


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and rank bytes of an array of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    sizes = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        sizes += ranks >= 1 << bits
    four = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    four.reshape(-1)[:len(ranks)] = sizes - 1
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = int(sizes.max(initial=1))
    kept = np.arange(width, dtype=np.uint8) < sizes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[:, :width][kept].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks, found by looking up control bytes."""
    sizes = SIZES[control].reshape(-1)[:n]
    places = np.cumsum(sizes, dtype=np.int64) - sizes
    out = data[places].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= data[places[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(first: int, doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join([
        HEADER.pack(MAGIC, len(doc_ids), len(ranks), len(data), first),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        lengths.astype("<u8").tobytes(), control, data])


def read_block(block: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """`(first, doc ids, ids per document, ranks)`."""
    magic, docs, n, size, first = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEADER.size
    ids = np.frombuffer(block, "<i8", docs, at).tolist()
    known = np.frombuffer(block, np.uint8, docs, at := at + 8 * docs).tolist()
    lengths = np.frombuffer(block, "<u8", docs, at := at + docs).astype(np.int64)
    control = np.frombuffer(block, np.uint8, -(-n // 4), at := at + 8 * docs)
    data = np.frombuffer(block, np.uint8, size, at + len(control))
    return first, [i if k else None for i, k in zip(ids, known, strict=True)], lengths, unpack(control, data, n)


IDS = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("tally", pa.binary())])
IDS_DDL = "part int, before long, doc_id long, n long, ids binary, tally binary"
COUNTS = pa.schema([("id", pa.int32()), ("n", pa.int64())])
BLOCKS = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("block", pa.binary())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _tokenise(path: str, end_id: int, size: int):
    """A row for each document, and one that has only the partition's tally."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = shared(BlankCut, path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        total = np.zeros(size, np.int64)
        for batch in gathered(batches, MANY_CHARS):
            texts, doc_ids = [t or "" for t in batch["text"].to_pylist()], batch["doc_id"].to_pylist()
            for a, b in slices(texts, MANY_CHARS):
                ids = [x + end for x in encoder.encode(texts[a:b])]
                n = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
                yield _batch(IDS, np.full(b - a, part), before + np.cumsum(n) - n, doc_ids[a:b], n, ids, [None] * (b - a))
                before += int(n.sum())
                total += np.bincount(np.frombuffer(b"".join(ids), encoder.dtype), minlength=size)
        seen = np.flatnonzero(total)
        tally = np.empty(len(seen), TALLY)
        tally["id"], tally["n"] = seen, total[seen]
        yield _batch(IDS, [part], [before], [None], [0], [None], [tally.tobytes()])
    return run


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for tally in batch["tally"]:
                tally = np.frombuffer(tally.as_buffer(), TALLY)
                total[tally["id"]] += tally["n"]
        seen = np.flatnonzero(total)
        yield _batch(COUNTS, seen, total[seen])
    return run


def _blocks(dtype: str, rank: np.ndarray, offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, before, doc_ids = batch["part"].to_numpy(), batch["before"].to_numpy(), batch["doc_id"].to_pylist()
            lengths, ids = batch["n"].to_numpy(), batch["ids"].to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for low, high in zip(edges, edges[1:], strict=False):
                for a, b in slices(ids[low:high]):
                    a, b = low + a, low + b
                    first = offsets[int(parts[a])] + int(before[a])
                    ranks = rank[np.frombuffer(b"".join(ids[a:b]), dtype)]
                    yield _batch(BLOCKS, [int(parts[a])], [first], [write_block(first, doc_ids[a:b], lengths[a:b], ranks)])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text, each document closed by `end_id`, in ascending order of ids.

    A null text is an empty one: just `end_id`. Null ids come first. Documents that share an id are ordered by their
    text's hash, so the files don't depend on how the table is stored. Other columns are not read.
    """
    spark = docs.sparkSession
    encoder = shared(BlankCut, tokenizer)
    dtype, size = encoder.dtype.str, max(len(encoder.names), end_id + 1)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    ids_path = work_path(spark, "ids")
    ordered.mapInArrow(_tokenise(tokenizer, end_id, size), IDS_DDL).write.option("compression", "zstd").parquet(ids_path)
    ids = spark.read.schema(IDS_DDL).parquet(ids_path)
    # Both tables are small by nature: a row for each id of the vocabulary, and a row for each partition.
    tallies = ids.filter("tally is not null").select("tally")
    counts = tallies.mapInArrow(_count(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    totals = {r["part"]: r["n"] for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    by_rank = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], np.uint32)
    rank = np.zeros(size, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    offsets, at = {}, 0
    for part in sorted(totals):
        offsets[part], at = at, at + totals[part]
    (ids.filter("tally is null").drop("tally").mapInArrow(_blocks(dtype, rank, offsets), "part int, first long, block binary")
     .sortWithinPartitions("part", "first")
     .write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks"))


def _decode(by_rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"]:
                first, doc_ids, lengths, ranks = read_block(block.as_py())
                ids, ends = by_rank[ranks].astype("<u4"), np.cumsum(lengths)
                yield _batch(TOKENS, doc_ids, first + ends - lengths, lengths,
                             [ids[b - n:b].tobytes() for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)])
    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, start, n_tokens, ids)` from files of `write_tokens`; `ids` are little-endian unsigned 32-bit integers."""
    ranks = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").collect()
    by_rank = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        by_rank[r["rank"]] = r["id"]
    blocks = spark.read.schema("block binary, part int").parquet(f"{path}/blocks").select("block")
    return blocks.mapInArrow(_decode(by_rank), "doc_id long, start long, n_tokens long, ids binary")


@query("op4_frequency_ranked_tokens")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, as read back from the files."""
    import public_tokenizers

    path = work_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
