"""Product codes of vectors: exact integer k-means per part, with LAESA pivots in front of the distances.

Every component becomes an integer and every vector is cut into parts. Per part position a few pivots are fixed at the
start, farthest first among the starting entries. Each part's distances to its pivots are computed once and stored beside
it. In every round the pivots' distances to the codebook's entries are computed anew, a handful of numbers. By the triangle
inequality `|d(part, pivot) - d(pivot, entry)|` is a lower bound of `d(part, entry)`: entries are tried in the order of their
bounds, exactly and in integers, until the next bound is beyond the best distance found. Ties go to the lower index.

The rounds are Spark jobs over the stored parts. A task adds up its own parts per entry, so what is shuffled and sent to the
driver is a codebook per task, whatever the table holds.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textroute.llm.registry import query, table
from textroute.session import broadcast_if_small, materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
PIVOTS = 4
#: What bounds computed in doubles may be off by, relative and absolute.
SLACK = 1e-9


def component_limit(part_size: int) -> int:
    """The largest integer component for which squared distances of a part fit 63 bits: 2^28 for parts of eight."""
    return 1 << min(30, (62 - max(0, part_size - 1).bit_length()) // 2 - 1)


def integers(vectors: np.ndarray, limit: int) -> np.ndarray:
    """floor(SCALE * x) of each component. Components beyond `limit` count as the limit."""
    return np.clip(np.floor(vectors * float(SCALE)), -limit, limit).astype(np.int64)


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Indexes of the first entry and of those farthest from all chosen before it, ties to the lower index."""
    chosen = [0]
    nearest = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of `parts` to rows of `points`, from exact squares."""
    return np.sqrt(((parts[:, None, :] - points[None, :, :]) ** 2).sum(axis=2).astype(np.float64))


def nearest(parts: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each row of `parts`, and how many distances were evaluated.

    `to_pivots` holds the rows' distances to `pivots`.
    """
    n, k = len(parts), len(entries)
    of_entries = distances(pivots, entries)
    bounds = np.zeros((n, k))
    for p in range(len(pivots)):
        np.maximum(bounds, np.abs(to_pivots[:, p, None] - of_entries[None, p, :]), out=bounds)
    bounds = np.maximum(bounds * (1 - SLACK) - SLACK * (1 + to_pivots.max(axis=1, initial=0)[:, None]), 0) ** 2
    order = np.argsort(bounds, axis=1, kind="stable")
    index, best = np.full(n, k, np.int64), np.full(n, np.iinfo(np.int64).max, np.int64)
    rows, evaluated = np.arange(n), 0
    for place in range(k):
        tried = order[rows, place]
        open_ = bounds[rows, tried] <= best[rows]
        rows, tried = rows[open_], tried[open_]
        if not len(rows):
            break
        evaluated += len(rows)
        exact = ((parts[rows] - entries[tried]) ** 2).sum(axis=1)
        better = (exact < best[rows]) | ((exact == best[rows]) & (tried < index[rows]))
        index[rows[better]], best[rows[better]] = tried[better], exact[better]
    return index, best, evaluated


@dataclass(frozen=True)
class Codebooks:
    """Entries and pivots of every part position, both of shape (parts, count, part size)."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, parts: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each part of each vector, and the number of evaluations."""
        found = [nearest(parts[:, p], to_pivots[:, p], self.pivots[p], self.entries[p]) for p in range(len(self.entries))]
        return (np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1), sum(f[2] for f in found))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype: type) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col("vector").isNotNull() & fine)


def starting_vectors(rows: DataFrame) -> list[list[float]]:
    """The vectors of the `ENTRIES` smallest ids, in the order of the ids; null ids come last. Of rows that share an id, the smallest counts."""
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    known = [i for i in ids if i is not None]
    chosen = F.col("vec_id").isin(known) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    first = {r.vec_id: r.vector for r in rows.filter(chosen).groupBy("vec_id").agg(F.min("vector").alias("vector")).collect()}
    return [first[i] for i in ids]


def with_pivots(rows: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """`(vec_id, label, parts, to_pivots)`: integer components and each part's distances to its pivots, once for all rounds."""
    shape = (PARTS, width // PARTS)
    limit, pivots = component_limit(shape[1]), books.pivots

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = integers(_matrix(batch.column("vector"), width, np.float64), limit)
                parts = whole.reshape(-1, *shape)
                far = np.concatenate([distances(parts[:, p], pivots[p]) for p in range(PARTS)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _lists(whole, pa.int32()),
                                                  _lists(far, pa.float64())], ["vec_id", "label", "parts", "to_pivots"])
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("parts", T.ArrayType(T.IntegerType())),
                           T.StructField("to_pivots", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(convert, schema)


def _read(batch: pa.RecordBatch, width: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    return (_matrix(batch.column("parts"), width, np.int64).reshape(-1, PARTS, width // PARTS),
            _matrix(batch.column("to_pivots"), PARTS * pivots, np.float64).reshape(-1, PARTS, pivots))


def next_entries(stored: DataFrame, books: Codebooks, width: int) -> np.ndarray:
    """The entries after one round: each the floor of the mean of its parts, or as it was if it has none."""
    k, size, pivots = books.entries.shape[1], width // PARTS, books.pivots.shape[1]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, k, size), np.int64), np.zeros((PARTS, k), np.int64)
        for batch in batches:
            parts, far = _read(batch, width, pivots)
            index = books.assign(parts, far)[0]
            for p in range(PARTS):
                np.add.at(sums[p], index[:, p], parts[:, p])
                counts[p] += np.bincount(index[:, p], minlength=k)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]),
                                          _lists(sums[p, e], pa.int64())], ["part", "entry", "n", "sums"])
    partial = stored.select("parts", "to_pivots").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
    whole = partial.select("part", "entry", "n", F.posexplode("sums").alias("place", "total")).groupBy("part", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    entries = books.entries.copy()
    for r in whole.collect():  # one number for each component of the codebooks
        entries[r.part, r.entry, r.place] = int(r.total) // r.n
    return entries


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
           rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """`(vec_id, label, code, error)` of each usable vector, stored, and the codebooks.

    A vector that is null or holds null or non-finite components is left out. The smallest id gives the number of
    components; a vector with another number of them, and every vector if it is 0 or no multiple of `PARTS`, has a null code and
    error and takes no part in the codebooks. Fewer than `ENTRIES` ids make shorter codebooks. Components whose integer is
    beyond `component_limit` count as the limit. Repeated rows count as often as they come, null ids and labels are kept, an
    empty table gives an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")))
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], schema), None
    width, nothing = first.n, [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if not width or width % PARTS:
        return rows.select("vec_id", "label", *nothing), None
    fit = rows.filter(F.size("vector") == width)
    start = np.array(starting_vectors(fit), np.float64).reshape(-1, width)
    entries = integers(start, component_limit(width // PARTS)).reshape(-1, PARTS, width // PARTS).transpose(1, 0, 2)
    books = Codebooks(entries, np.stack([e[choose_pivots(e)] for e in entries]))
    stored = materialize(with_pivots(fit, books, width), "parts")
    for _ in range(rounds):
        books = Codebooks(next_entries(stored, books, width), books.pivots)
    coded = materialize(stored.mapInArrow(_coder(books, width), schema).unionByName(
        rows.filter(F.size("vector") != width).select("vec_id", "label", *nothing)), "codes")
    return coded, books


def _coder(books: Codebooks, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    digits = np.array([f"{e:02x}" for e in range(ENTRIES)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, error, _ = books.assign(*_read(batch, width, books.pivots.shape[1]))
                codes = pa.array(["".join(row) for row in digits[index]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error.sum(axis=1))],
                                                 ["vec_id", "label", "code", "error"])
    return code


def with_label_error(coded: DataFrame) -> DataFrame:
    """The error summed over the rows of an equal label, null among equals, beside each row."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of_label")
    return coded.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")


def _sql() -> str:
    """The same by unrolled rounds, every distance evaluated."""
    fine = "list_count(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)"
    out = [f"kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v "
           f"from embeddings where embedding is not null and {fine})",
           f"parts as materialized (select vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as x "
           f"from kept cross join range({PARTS}) as t(p))",
           f"book0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts "
           f"qualify row_number() over (partition by p order by vec_id) <= {ENTRIES})"]
    dist = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::bigint"
    for r in range(ROUNDS + 1):
        out.append(f"near{r} as materialized (select vec_id, label, p, any_value(x) as x, min({{'d': {dist}, 'e': e}}) as m "
                   f"from parts join book{r} using (p) group by vec_id, label, p)")
        if r < ROUNDS:
            out.append(
                f"mean{r} as materialized (select p, e, list(c order by i) as c from (select p, m.e as e, i, "
                "((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::bigint as c "
                f"from (select p, m, unnest(x) as y, unnest(range(len(x))) as i from near{r}) group by p, m.e, i) group by p, e)")
            out.append(f"book{r + 1} as materialized (select b.p, b.e, coalesce(n.c, b.c) as c from book{r} b left join mean{r} n on n.p = b.p and n.e = b.e)")
    return f"""
with {", ".join(out)},
coded as (select vec_id, any_value(label) as label, string_agg(format('{{:02x}}', m.e), '' order by p) as code, sum(m.d)::bigint as error
          from near{ROUNDS} group by vec_id),
books as (select sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' order by p, e)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded cross join books
"""


@query("op13_laesa_vector_codes", _sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, with its label's error and the codebooks' digest."""
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
