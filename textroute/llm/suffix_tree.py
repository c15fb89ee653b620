"""Language-model scores from a probabilistic suffix tree over words.

A context is a run of up to `DEPTH` words. Its node stays in the tree if the words that follow it diverge from those that follow
its suffix (the context without its first word): the log-likelihood ratio of its training words must reach `ln(N + V + 1)`, a
threshold that grows as the description of one more node does. A context seen once can't reach it, and neither can one that is
rare beside its suffix, so such contexts needn't be looked at. The words of a node are smoothed by its suffix (Witten and Bell): `(c(s, w) + t(s) p(w | suffix)) / (c(s) +
t(s))` with `t(s)` distinct words after `s`; the root adds one. A word is scored in the longest of its contexts that stays. Nodes
between a kept one and the root belong to the tree, so the probabilities of a chain build on each other.

How the data moves, at any size:

1. Documents become blocks of some `BLOCK` tokens: hashes of the block's distinct words and their ranks. The text is read once.
2. For each depth, a block asks for its distinct (context, word) pairs, by buckets of the contexts' hashes, and adds its own training
   counts. A bucket adds up what all blocks say, tests its contexts and answers in the order it was asked, so answers carry
   counts only. Pairs whose count follows from the depth before aren't asked for.
3. A context with more than a block of occurrences is dealt to several buckets by its words. These return partial sums that
   Spark adds up; such contexts are few by count (at most 2^20) and known to all tasks in the next step.
4. With the answers of all depths, a block scores its documents.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textroute.llm.registry import query, table
from textroute.llm.samples import held_out
from textroute.session import materialize

DEPTH = 2
#: Tokens of a block, and occurrences beyond which a context is dealt to several buckets.
BLOCK = 3 << 19
#: log2 of the most contexts that may be dealt to several buckets.
HOT_BITS = 20
#: Words within a context are told apart by that many bits of their hash.
KEY_BITS = 48
END_WORD = b""
#: Block number of the rows that hold partial sums of hot contexts.
SUMS = -1


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word, A-Z in lower case, and of the end."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters, the six ASCII blanks
    words.append(END_WORD)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, the first bytes of all numbers first."""
    import zstandard

    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def blocks_of(docs: DataFrame, block: int) -> DataFrame:
    """`(block, doc_ids, lengths, train, words, ranks)` of `(doc_id, text, train)`: whole documents, about `block` tokens a row."""
    kind = docs.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, lengths, train, hashes, size, types = [], [], [], [], 0, None

        def row() -> pa.RecordBatch:
            words, ranks, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            cells = [number, ids, pack(np.array(lengths, np.uint32)), pack(np.array(train, np.uint8)), pack(words[order]), pack(place[ranks])]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int64(), pa.list_(types), *[pa.binary()] * 4])],
                                              ["block", "doc_ids", "lengths", "train", "words", "ranks"])
        for batch in batches:
            types = batch.schema.field("doc_id").type
            for i, text, learn in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train"))):
                hashes.append(word_hashes(text))
                ids.append(i)
                lengths.append(len(hashes[-1]))
                train.append(bool(learn))
                size += lengths[-1]
                if size >= block:
                    yield row()
                    number, size = number + 1, 0
                    ids, lengths, train, hashes = [], [], [], []
        if ids:
            yield row()
    binary = [T.StructField(n, T.BinaryType()) for n in ("lengths", "train", "words", "ranks")]
    return docs.mapInArrow(encode, T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), *binary]))


@dataclass(frozen=True)
class Plan:
    """What all blocks know: log2 of the number of buckets, size of a block, N and V, hot contexts of each depth with their answers."""

    bits: int
    block: int
    tokens: int = 0
    words: int = 0
    hot: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    @property
    def threshold(self) -> float:
        return float(np.log(self.tokens + self.words + 1))

    @property
    def hot_count(self) -> int:
        return max(self.block, self.tokens >> HOT_BITS)


@dataclass
class Ask:
    """The distinct pairs of a block at one depth, in the order of bucket, context and word."""

    bucket: np.ndarray  # of each context
    context: np.ndarray
    sizes: np.ndarray  # words of each context
    key: np.ndarray
    n: np.ndarray  # training occurrences of each word
    single: np.ndarray  # of each context: training occurrences whose count is known to be one
    logs: np.ndarray  # of each context: sum of ln p(w | suffix) over its training occurrences
    hot: np.ndarray
    of_position: np.ndarray  # each position's place among the keys, or -1
    context_of: np.ndarray  # each position's place among the contexts, or -1


def ask(context: np.ndarray, key: np.ndarray, live: np.ndarray, keyed: np.ndarray, train: np.ndarray, log_p: np.ndarray,
        split: np.ndarray, bits: int) -> Ask:
    """`live`: positions whose context matters; `keyed`: those of them whose pair must be counted; `split`: pieces of each position's context.

    One sort by the first bits of both hashes brings equal pairs together. Contexts whose first bits agree may alternate, and
    then come more than once, which the sums and answers of a bucket allow for.
    """
    at = np.flatnonzero(live)
    c, k, pieces = context[at], key[at], split[at]
    home = np.where(pieces > 1, mixed(c, k % pieces), c)
    order = np.argsort((home >> np.uint64(28) << np.uint64(28)) | (k >> np.uint64(KEY_BITS - 28)))
    c, k, home, at = c[order], k[order], home[order], at[order]
    new_context = np.ones(len(at), bool)
    new_context[1:] = (c[1:] != c[:-1]) | (home[1:] != home[:-1])
    which = np.cumsum(new_context) - 1
    count = int(which[-1]) + 1 if len(which) else 0
    counted, own = keyed[at], train[at]
    new_key = new_context.copy()
    new_key[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new_key) - 1
    has_key = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    has_key[group[counted]] = True
    place = np.where(has_key, np.cumsum(has_key) - 1, -1)
    firsts = np.flatnonzero(new_key)[has_key]
    mine = np.where(counted, place[group], -1)
    of_position, context_of = np.full(len(context), -1, np.int32), np.full(len(context), -1, np.int32)
    of_position[at], context_of[at] = mine, which
    return Ask(bucket_of(home[new_context], bits), c[new_context], np.bincount(which[firsts], minlength=count), k[firsts],
               np.bincount(mine[counted & own], minlength=len(firsts)), np.bincount(which[own & ~counted], minlength=count),
               np.bincount(which[own], log_p[at][own], minlength=count), pieces[order][new_context] > 1, of_position, context_of)


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits) if bits else np.zeros_like(hashes)).astype(np.int64)


class Block:
    """A block's tokens and, depth by depth, what is known of them."""

    def __init__(self, row: dict, plan: Plan) -> None:
        self.plan, self.ids = plan, row["doc_ids"]
        self.lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words, self.ranks = unpack(row["words"], np.uint64), unpack(row["ranks"], np.uint32)
        self.tokens = self.words[self.ranks]
        self.train = np.repeat(unpack(row["train"], np.uint8).astype(bool), self.lengths)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)

    def ask(self, depth: int) -> Ask:
        """The request of a depth, once the answers of all depths before are in."""
        if depth == 0:
            return self.ask_words()
        if depth == 1:
            context, self.of_context = np.roll(self.tokens, 1), np.roll(self.count, 1)
            self.log_p = np.log(self.p)
            rarest = np.log((self.plan.tokens + self.plan.words + 1) / 2)  # a known word has p(w) of 2 in N + V + 1 at least
        else:
            pair = mixed(self.context, self.tokens)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.log_p = np.where(self.count > 0, np.log(self.count / self.of_context), 0.0)
            rarest = np.log(np.maximum(self.of_context, 1))  # and one seen after the suffix 1 in the suffix's count
            context, self.of_context = np.roll(pair, 1), np.where(np.roll(self.known, 1), np.roll(self.count, 1), 0)
        self.context = context
        # A context whose count can't make up the threshold, however it diverges, can't stay, nor can any longer one that ends in it.
        self.live = self.known & (self.place >= depth) & (self.of_context > 1) & (self.of_context * rarest >= self.plan.threshold)
        self.once = self.train & (self.count == 1)  # the suffix has the word once: so does the context
        split = np.where(self.of_context > self.plan.hot_count, -(-self.of_context // self.plan.block), 1).astype(np.uint64)
        key = mixed(self.tokens, np.uint64(depth)) >> np.uint64(64 - KEY_BITS)
        return ask(context, key, self.live, self.live & ~self.once, self.train, self.log_p, split, self.plan.bits)

    def ask_words(self) -> Ask:
        """The first request: every word is a context of its own, with one key."""
        order = np.argsort(self.words)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        n = np.bincount(self.ranks[self.train], minlength=len(order))[order]
        zero, of_position = np.zeros(len(order), np.int64), place[self.ranks]
        return Ask(bucket_of(self.words[order], self.plan.bits), self.words[order], zero + 1, zero.astype(np.uint64), n, zero, zero.astype(float),
                   zero > 0, of_position, of_position)

    def read(self, depth: int, asked: Ask, counts: np.ndarray, after: np.ndarray) -> None:
        """Takes in the answers: each pair's count and, of each context, twice the number of words after it, plus one if it stays."""
        if depth == 0:
            self.count = counts[asked.of_position]
            self.p = self.best = (self.count + 1) / (self.plan.tokens + self.plan.words + 1)
            self.seen, self.known = self.count, np.ones(len(self.tokens), bool)
            return
        names, sums = self.plan.hot[depth - 1]
        if asked.hot.any():
            after = np.where(asked.hot, sums[np.minimum(np.searchsorted(names, asked.context), len(names) - 1)], after)
        self.known = live = self.live
        found = counts[asked.of_position] if len(counts) else np.zeros(len(live), np.int64)
        self.count = np.where(live, np.where(asked.of_position >= 0, found, self.once), 0)
        node = np.where(live, after[asked.context_of], 0) if len(after) else np.zeros(len(live), np.int64)
        # A node that doesn't stay by itself is on the way to those that do, so its words are smoothed all the same.
        spread = node >> 1
        self.p = np.where(live, (self.count + spread * self.p) / np.maximum(self.of_context + spread, 1), self.p)
        self.best = np.where(node & 1 == 1, self.p, self.best)

    def scores(self) -> tuple[np.ndarray, ...]:
        """Of each document: tokens, known tokens, base score and score."""
        base = np.log10((self.seen + 1) / (self.plan.tokens + self.plan.words + 1))
        sums = [np.add.reduceat(x, self.starts) for x in ((self.seen > 0).astype(np.int64), base, np.log10(self.best))]
        return self.lengths, *sums


REQUEST = "block long, bucket int, asked array<binary>"
REPLY = ("block long, bucket int, counts binary, after binary, tokens long, words long, "
         "sums array<struct<name:long,c:double,t:double,a:double,b:double>>")


def requests(block: Block, number: int, depth: int) -> pa.Table:
    """A block's request as one row for each bucket that it concerns."""
    x = block.ask(depth)
    buckets, begin = np.unique(x.bucket, return_index=True)
    ends, keys = np.append(begin[1:], len(x.bucket)), np.append(0, np.cumsum(x.sizes))
    rows = []
    for i, j in zip(begin, ends):
        k, m = keys[i], keys[j]
        rows.append([pack(np.diff(x.context[i:j], prepend=np.uint64(0))), pack(x.sizes[i:j].astype(np.uint32)), pack(x.key[k:m]), pack(x.n[k:m].astype(np.uint32)),
                     pack(x.single[i:j].astype(np.uint32)), pack(x.logs[i:j].astype(np.float32)), pack(x.hot[i:j].astype(np.uint8))])
    return pa.table({"block": pa.array([number] * len(rows), pa.int64()), "bucket": pa.array(buckets, pa.int32()),
                     "asked": pa.array(rows, pa.list_(pa.binary()))})


def answers(asked: pa.Table, threshold: float) -> pa.Table:
    """All requests to a bucket: a row of counts for each, and one of sums."""
    asked = asked.sort_by("block")
    kinds = (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.float32, np.uint8)
    parts = [[unpack(cell, kind) for cell, kind in zip(row, kinds)] for row in asked.column("asked").to_pylist()]
    for row in parts:
        row[0] = np.cumsum(row[0], dtype=np.uint64)
    context, sizes, key, n, single, logs, hot = (np.concatenate(x) for x in zip(*parts))
    contexts, which = np.unique(context, return_inverse=True)
    of_key = np.repeat(which, sizes)
    pairs, pair = np.unique(mixed(contexts[of_key], key), return_inverse=True)
    total = np.bincount(pair, n, len(pairs)).astype(np.int64)
    owner = np.zeros(len(pairs), np.int64)
    owner[pair] = of_key
    k = len(contexts)
    alone = np.bincount(which, single, k)
    c, t = np.bincount(owner, total, k) + alone, np.bincount(owner, total > 0, k) + alone
    a, b = np.bincount(owner, total * np.log(np.maximum(total, 1)), k), np.bincount(which, logs.astype(np.float64), k)
    after = (2 * t + stays(c, a, b, threshold)).astype(np.uint32)[which]
    names = np.unique(which[hot.astype(bool)])
    sums = [{"name": int(contexts[i].view(np.int64)), "c": c[i], "t": t[i], "a": a[i], "b": b[i]} for i in names]
    counts, words = np.cumsum([0, *(len(r[2]) for r in parts)]), np.cumsum([0, *(len(r[0]) for r in parts)])
    rows = {"block": [*asked.column("block").to_pylist(), SUMS], "bucket": [asked.column("bucket")[0].as_py()] * (len(parts) + 1),
            "counts": [*(pack(total[pair[i:j]].astype(np.uint32)) for i, j in zip(counts, counts[1:])), None],
            "after": [*(pack(after[i:j]) for i, j in zip(words, words[1:])), None],
            "tokens": [*[None] * len(parts), int(total.sum())], "words": [*[None] * len(parts), int((total > 0).sum())],
            "sums": [*[None] * len(parts), sums]}
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(),
             pa.list_(pa.struct([("name", pa.int64()), *((x, pa.float64()) for x in "ctab")]))]
    return pa.table([pa.array(v, kind) for v, kind in zip(rows.values(), types)], names=list(rows))


def stays(c: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The divergence test: the log-likelihood ratio of a context's words against its suffix reaches the threshold."""
    return (c > 1) & (a - c * np.log(np.maximum(c, 1)) - b >= threshold)


def informed(left: pa.Table, right: pa.Table, plan: Plan, depths: int) -> Block:
    """A block that has read the answers of the first `depths` depths."""
    block = Block(left.to_pylist()[0], plan)
    replies = right.sort_by([("depth", "ascending"), ("bucket", "ascending")]).select(["depth", "counts", "after"]).to_pylist()
    for depth in range(depths):
        mine = [r for r in replies if r["depth"] == depth]
        counts, after = (np.concatenate([np.zeros(0, np.int64), *(unpack(r[c], np.uint32) for r in mine)]).astype(np.int64) for c in ("counts", "after"))
        block.read(depth, block.ask(depth), counts, after)
    return block


def hot_sums(replies: DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The contexts that several buckets share, 2^20 at most, and their answers."""
    rows = replies.filter(F.col("block") == SUMS).select(F.explode("sums").alias("s")).select("s.*").groupBy("name").agg(
        *(F.sum(x).alias(x) for x in "ctab")).toPandas()
    names = rows["name"].to_numpy(np.int64).view(np.uint64)
    c, t, a, b = (rows[x].to_numpy(np.float64) for x in "ctab")
    order = np.argsort(names)
    return names[order], (2 * t + stays(c, a, b, threshold)).astype(np.int64)[order]


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, block: int = BLOCK) -> tuple[DataFrame, int]:
    """`(doc_id, n_tokens, n_known, base_score, score)` of each row of `docs`, and the number of training tokens.

    `learn` tells which rows to learn from; null is no. A null text counts as empty and has one token, its end. Scores are log10
    probabilities of the whole text. Repeated rows are learnt from and returned as often as they come, null ids are kept. Without
    any training row every word has probability one; an empty table gives an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    # Kept where they are dealt to, so that all steps join answers to them without moving them again; a lost part is read anew.
    lanes = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    blocks = blocks_of(rows, block).repartition(lanes, "block").persist(StorageLevel.DISK_ONLY)
    plan, replies = Plan((max(lanes, blocks.count()) - 1).bit_length(), block), None
    for d in range(depth + 1):
        if replies is None:
            asked = blocks.mapInArrow(_first_requests(plan), REQUEST)
        else:
            asked = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_requests(plan, d), REQUEST)
        limit = plan.threshold
        found = materialize(asked.groupBy("bucket").applyInArrow(_answers(limit), REPLY), f"answers-{d}")
        if d == 0:
            size = found.filter(F.col("block") == SUMS).agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
            plan = replace(plan, tokens=size.tokens or 0, words=size.words or 0)
        else:
            plan = replace(plan, hot=(*plan.hot, hot_sums(found, limit)))
        mine = found.filter(F.col("block") != SUMS).select("block", "bucket", "counts", "after", F.lit(d).alias("depth"))
        replies = mine if replies is None else replies.unionByName(mine)
    scored = materialize(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scores(plan, depth, schema.names), schema), "scores")
    blocks.unpersist()
    return scored, plan.tokens


def _first_requests(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from requests(Block(row, plan), row["block"], 0).to_batches()
    return run


def _requests(plan: Plan, depth: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return requests(informed(left, right, plan, depth), left.column("block")[0].as_py(), depth)
    return run


def _answers(threshold: float):
    def run(asked: pa.Table) -> pa.Table:
        return answers(asked, threshold)
    return run


def _scores(plan: Plan, depth: int, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = informed(left, right, plan, depth + 1)
        return pa.table([pa.array(block.ids, left.schema.field("doc_ids").type.value_type), *map(pa.array, block.scores())], names=names)
    return run


@query("op12_suffix_tree_score")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the tree of the documents that aren't held out."""
    out = held_out(F.col("doc_id"), 7, 2)
    scored, tokens = score(table(spark, sf_dir, "documents"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
