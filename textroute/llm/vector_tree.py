"""Nearest neighbours by inner product, through a tree of k-means clusters.

A sample of bounded size is clustered, each cluster again, down to the leaves; every vector is indexed under the
leaf it descends to. A query goes through the tree best bin first: a priority queue holds the nodes seen so
far, the one whose centre has the largest inner product with the query is opened next. How many leaves are
opened is calibrated: the exact neighbours of some queries are found by a scan, and the visits are widened until the
wanted recall is reached, up to all leaves.

Equal vectors are indexed once, with as many of their ids as a result can hold. Neighbouring leaves are scored together, in
blocks of bounded size on both sides; a query that opens a leaf also meets the others of its block, which can only add to what
it finds, and gets one short list from the block.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textroute.llm.registry import query, table
from textroute.session import materialize

#: Vectors that the tree is fitted on, queries that calibrate it, and the recall they have to reach.
SAMPLE = 20_000
CALIBRATION = 200
RECALL = 0.97
BRANCH = 16
#: Wanted vectors of a leaf, and leaves at most.
LEAF = 256
LEAVES = 4096
#: Bytes of vectors in a block, and queries of a block.
BLOCK_BYTES, QUERIES_AT_ONCE = 1 << 23, 256
ROUNDS = 12


@dataclass(frozen=True)
class Tree:
    """Centres of all nodes, the root first; children of each node, none for a leaf; a leaf's number, -1 for others."""
    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's method; centres that lose all their points are left out."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums[sizes > 0] / sizes[sizes > 0][:, None]
    return centres


def build_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree with about as many leaves as wanted, clusters of many points being cut further."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1] if sample.ndim == 2 else 1
    centres, children, members = [np.zeros(dims)], [np.zeros(0, int)], [np.arange(len(sample))]
    most = max(1, -(-len(sample) // max(1, leaves)))
    at = 0
    while at < len(centres):
        rows = members[at]
        if len(rows) > most and len(rows) >= 2:
            k = min(BRANCH, max(2, -(-len(rows) // most)), len(rows))
            found = _clusters(sample[rows], k, rng)
            if len(found) > 1:
                own = _nearest(sample[rows], found)
                children[at] = np.arange(len(centres), len(centres) + len(found))
                for i, centre in enumerate(found):
                    centres.append(centre)
                    children.append(np.zeros(0, int))
                    members.append(rows[own == i])
        at += 1
    end = np.array([len(c) == 0 for c in children])
    return Tree(np.array(centres), children, np.where(end, np.cumsum(end) - 1, -1))


def descend(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf number of each row."""
    node, out = np.zeros(len(x), int), np.zeros(len(x), np.int32)
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        at, rows = waiting.pop()
        kids = tree.children[at]
        if not len(kids):
            out[rows] = tree.leaf[at]
        elif len(rows):
            node = _nearest(x[rows], tree.centres[kids])
            waiting += [(int(kid), rows[node == i]) for i, kid in enumerate(kids)]
    return out


def best_bins(q: np.ndarray, tree: Tree, visits: int, sizes: np.ndarray, least: int) -> list[int]:
    """Leaves in the order in which they are opened: `visits` of them, and more until they hold `least` vectors."""
    heap, found, held = [(0.0, 0)], [], 0
    while heap and (len(found) < visits or held < least):
        _, at = heapq.heappop(heap)
        kids = tree.children[at]
        if len(kids):
            for score, kid in zip((tree.centres[kids] @ q).tolist(), kids.tolist(), strict=True):
                heapq.heappush(heap, (-score, kid))
        else:
            found.append(int(tree.leaf[at]))
            held += int(sizes[tree.leaf[at]])
    return found


def bundles(sizes: np.ndarray, most: int) -> np.ndarray:
    """The bundle of each leaf: leaves in a row with at most `most` vectors together. A larger leaf is one by itself."""
    out, at, held = np.zeros(len(sizes), np.int32), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            at, held = at + 1, 0
        out[leaf], held = at, held + n
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products that don't depend on what else is in the block."""
    return (x[rows] * q).sum(axis=1)


def _top(q: np.ndarray, x: np.ndarray, first: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the `k` largest inner products, ties to the smaller first id, and these products."""
    rows = np.arange(len(x))
    if len(x) > k:
        bound = np.partition(rough, len(x) - k)[len(x) - k]
        rows = np.flatnonzero(rough >= bound - 1e-9 * max(1.0, abs(bound)))
    exact = _scores(q, x, rows)
    order = np.lexsort((first[rows], -exact))[:k]
    return rows[order], exact[order]


def _as_bytes(name: str):
    """Vectors as bytes of doubles, which later tasks read without unpacking arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch[name].flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["vkey"], batch["ids"], pa.array([v.tobytes() for v in values], pa.binary())], names=["vkey", "ids", "v"])
    return run


def _assign(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = descend(_matrix(batch["v"]), tree) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch["vkey"], batch["ids"], batch["v"], pa.array(leaf, pa.int32())], names=["vkey", "ids", "v", "leaf"])
    return run


def _scan(queries: np.ndarray, k: int):
    """The leaves of each query's exact neighbours among the rows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            x, leaf = _matrix(batch["v"]), batch["leaf"].to_pylist()
            first = np.array([ids[0] for ids in batch["ids"].to_pylist()])
            for i, (q, rough) in enumerate(zip(queries, queries @ x.T, strict=True)):
                rows, exact = _top(q, x, first, rough, k)
                best[i] = sorted([*best[i], *((-s, int(first[r]), leaf[r]) for r, s in zip(rows.tolist(), exact.tolist(), strict=True))])[:k]
        rows = [(i, -s, f, b) for i, found in enumerate(best) for s, f, b in found]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()),
                                          pa.array(columns[3], pa.int32())], names=["q", "score", "first", "leaf"])
    return run


def _route(tree: Tree, visits: int, sizes: np.ndarray, least: int, bundle: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = (best_bins(q, tree, visits, sizes, least) for q in _matrix(batch["v"])) if batch.num_rows else []
            bins = [np.unique(bundle[leaves]) for leaves in opened]
            yield pa.RecordBatch.from_arrays([batch["vkey"], batch["v"], pa.array(bins, pa.list_(pa.int32()))], names=["qkey", "qv", "bins"])
    return run


FOUND = pa.schema([("qkey", pa.string()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])


def _score(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        x, qs, ids = _matrix(vectors["v"]), _matrix(queries["qv"]), vectors["ids"].to_pylist()
        first = np.array([i[0] for i in ids])
        keys, scores, found = [], [], []
        for key, q, rough in zip(queries["qkey"].to_pylist(), qs, qs @ x.T, strict=True):
            rows, exact = _top(q, x, first, rough, k)
            keys += [key] * len(rows)
            scores += exact.tolist()
            found += [ids[r] for r in rows.tolist()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((keys, scores, found), FOUND, strict=True)], schema=FOUND)
    return run


def _key(vector: Column) -> Column:
    return F.concat(F.hex(F.xxhash64(vector)), F.hex(F.xxhash64(F.lit(1), vector)))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """`(vkey, ids, v)`: each distinct vector once, with its `k` smallest ids; the cut is made before the exchange."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vkey").orderBy("id"))).filter(F.col("rank") <= k)
    once = ranked.groupBy("vkey").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector"))
    return once.mapInArrow(_as_bytes("vector"), "vkey string, ids array<long>, v binary")


def search(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the `k` nearest rows found for each query, itself left out, nearest first.

    `is_query` is a condition on the column `id`. Rows whose id is null, or whose vector is null, zero, of another length
    than most or holds a null or non-finite component take no part, neither as queries nor as candidates. Rows that
    share an id count once, with the vector of smallest hash. Ties go to the smaller id. Fewer candidates than `k` are
    all returned. An empty table gives an empty table. Other columns are not read.
    """
    spark, top = df.sparkSession, k + 1
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda c: c != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vector") == (lengths["n"] if lengths else 0)).withColumn("vkey", _key(F.col("vector")))
    rows = materialize(rows.groupBy("id").agg(F.min_by(F.struct("vector", "vkey"), "vkey").alias("row")).select("id", "row.*"), "vectors")
    vectors = materialize(distinct_vectors(rows, top), "distinct-vectors")

    n = vectors.count()
    hashed = F.xxhash64("vkey")
    share = F.pmod(hashed, F.lit(1_000_000)) < -(-2 * SAMPLE * 1_000_000 // max(1, n))
    sample = [r["v"] for r in vectors.filter(share).orderBy(hashed).limit(SAMPLE).select("v").collect()]
    tree = build_tree(np.frombuffer(b"".join(sample), "<f8").reshape(len(sample), -1) if sample else np.zeros((0, 1)), min(LEAVES, -(-n // LEAF)))
    index = materialize(vectors.mapInArrow(_assign(tree), "vkey string, ids array<long>, v binary, leaf int"), "index")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row for each leaf
        sizes[r["leaf"]] = r["count"]

    asked = rows.filter(is_query).select(F.col("id").alias("query_id"), F.col("vkey").alias("qkey"))
    queries = materialize(vectors.join(asked.select(F.col("qkey").alias("vkey")).distinct(), "vkey", "left_semi").select("vkey", "v"), "queries")
    probes = [r["v"] for r in queries.orderBy(hashed).limit(CALIBRATION).select("v").collect()]
    visits = calibrate(index, tree, sizes, np.frombuffer(b"".join(probes), "<f8").reshape(len(probes), -1), top, recall) if probes else 1

    dims = lengths["n"] if lengths else 1
    most = max(1, BLOCK_BYTES // (8 * dims))
    bundle = bundles(sizes, most)
    held = np.bincount(bundle, sizes, int(bundle.max()) + 1).astype(int)
    routed = materialize(queries.mapInArrow(_route(tree, visits, sizes, top, bundle), "qkey string, qv binary, bins array<int>"), "routed")
    blocks = spark.createDataFrame([(i, int(b), max(1, -(-int(held[b]) // most))) for i, b in enumerate(bundle)],
                                   "leaf int, bundle int, vector_blocks int")
    load = routed.select(F.explode("bins").alias("bundle")).groupBy("bundle").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).cast("int").alias("query_blocks"))
    blocks = materialize(blocks.join(load, "bundle"), "blocks")  # a row for each leaf at most
    # A vector goes to each block of queries of its bundle, a query to each block of vectors.
    left = (index.join(F.broadcast(blocks), "leaf").select("bundle", F.pmod(hashed, F.col("vector_blocks")).alias("vb"), "ids", "v", "query_blocks")
            .select("bundle", "vb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "ids", "v"))
    spread = F.broadcast(blocks.select("bundle", "vector_blocks", "query_blocks").distinct())
    right = (routed.select("qkey", "qv", F.explode("bins").alias("bundle")).join(spread, "bundle")
             .select("bundle", F.pmod(F.xxhash64("qkey"), F.col("query_blocks")).alias("qb"), "qkey", "qv", "vector_blocks")
             .select("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vector_blocks").cast("long") - 1)).alias("vb"), F.col("qb").cast("int").alias("qb"), "qkey", "qv"))
    key = ["bundle", "vb", "qb"]
    left = left.withColumn("vb", F.col("vb").cast("long"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_score(top), "qkey string, score double, ids array<long>")
    each = found.select("qkey", "score", F.explode("ids").alias("id"))
    best = (each.withColumn("rank", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= top)
            .groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near")))
    # Of the nearest k + 1, the query itself goes, or else the last.
    pairs = asked.join(best, "qkey").select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return pairs.select("query_id", F.posexplode("near").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def calibrate(index: DataFrame, tree: Tree, sizes: np.ndarray, probes: np.ndarray, k: int, recall: float) -> int:
    """The number of leaves to open so that on average this share of the probes' exact neighbours lies in them."""
    exact = index.select("ids", "v", "leaf").mapInArrow(_scan(probes, k), "q int, score double, first long, leaf int")
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))).filter(F.col("rank") <= k)
    leaves: list[list[int]] = [[] for _ in probes]
    for r in ranked.select("q", "leaf").collect():  # k rows for each probe
        leaves[r["q"]].append(r["leaf"])
    places = []
    for q, found in zip(probes, leaves, strict=True):
        place = {b: i for i, b in enumerate(best_bins(q, tree, tree.leaves, sizes, 0))}
        places.append(np.array([place[b] for b in found]))
    visits = 1
    while visits < tree.leaves and np.mean([(p < visits).mean() for p in places]) < recall:
        visits = min(tree.leaves, max(visits + 1, visits * 5 // 4))
    return visits


@query("op6_kmeans_tree_search")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
