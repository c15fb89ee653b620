"""Policy paragraphs: parsing, BM25 and vector search.

The corpus is the small side and the queries the large one. Queries are hash-partitioned once and
stay there; the index comes to them in blocks of bounded, measured size, and only the best `k`
chunks of a block leave a task.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, search_tokens, strip
from ..session import BROADCAST_LIMIT_BYTES, materialize, serialized_bytes, spread
from .block_scores import Block, best_of

GENERAL = "all"
BLOCK_CHUNKS = 5000

# Parameters of the ranking function.
K1, B, FLOOR = 1.5, 0.75, 0.25


def parse_front_matter(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `meta` (map of the header lines, the last of equal keys) and `body`.

    A page without a header has an empty map and its whole text as body.
    """
    pattern = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    has = F.col(raw).rlike(pattern)
    lines = F.filter(F.split(F.regexp_extract(raw, pattern, 1), r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"),
                     lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(lines, lambda line: F.struct(
        strip(F.regexp_extract(line, r"(?s)\A([^:]*):", 1)).alias("key"),
        strip(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1)).alias("value")))
    last = F.filter("_pairs", lambda x, i: ~F.exists(
        F.slice("_pairs", i + 2, F.size("_pairs")), lambda y: y["key"] == x["key"]))
    return (df.withColumn("_pairs", F.when(has, pairs).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
              .withColumn("meta", F.map_from_entries(last))
              .withColumn("body", F.when(has, F.regexp_extract(raw, pattern, 2)).otherwise(F.col(raw)))
              .drop("_pairs"))


def chunk_paragraphs(pages: DataFrame, min_chars: int = 40, raw: str = "raw", source: str = "source") -> DataFrame:
    """One chunk per paragraph of a page: `(id, source, title, products, text, position)`.

    Paragraphs that start with `#` are dropped before numbering, short ones after it, so the
    numbers keep gaps.
    """
    stem = F.regexp_replace(source, r"\.[^.]*$", "")
    paragraphs = F.filter(
        F.transform(F.split("body", rf"\n{SPACE}*\n"), strip),
        lambda p: (F.length(p) > 0) & ~F.startswith(p, F.lit("#")))
    products = F.transform(F.split(F.coalesce(F.try_element_at("meta", F.lit("products")), F.lit(GENERAL)), r"\|"), strip)
    return (parse_front_matter(pages, raw)
            .select(source, F.coalesce(F.try_element_at("meta", F.lit("title")), stem).alias("title"),
                    products.alias("products"), stem.alias("_stem"),
                    F.posexplode(paragraphs).alias("position", "text"))
            .filter(F.length("text") >= min_chars)
            .select(F.concat("_stem", F.lit("#"), F.col("position").cast("string")).alias("id"),
                    F.col(source).alias("source"), "title", "products", "text", "position"))


def tokenize(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", search_tokens(F.col(text)))


def postings(chunks: DataFrame) -> DataFrame:
    """`(id, term, tf, dl)`: term counts with the chunk's length in tokens."""
    tokens = spread(tokenize(chunks).select("id", "tokens"), "id")
    return (tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
                  .groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))


def inverse_frequencies(terms: DataFrame, n_chunks: Column | int) -> DataFrame:
    """`(term, df, idf)`; an idf below zero becomes a quarter of the mean over the vocabulary."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    n = n_chunks if isinstance(n_chunks, Column) else F.lit(n_chunks)
    raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = F.lit(FLOOR) * raw.agg(F.avg("raw")).scalar()
    return raw.withColumn("floor", floor).select(
        "term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25_weights(chunks: DataFrame) -> DataFrame:
    """`(id, term, tf, weight)`: what one occurrence of the term in a query adds to the chunk's score."""
    terms = postings(chunks)
    n = chunks.agg(F.count("*")).scalar()
    mean_length = tokenize(chunks).agg(F.avg(F.size("tokens"))).scalar()
    idf = inverse_frequencies(terms, n).select("term", "idf")
    length = F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("_mean")
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    return (terms.join(idf, "term").withColumn("_mean", mean_length)
                 .select("id", "term", "tf", (F.col("idf") * gain).alias("weight")))


def cosine_weights(chunks: DataFrame) -> DataFrame:
    """`(id, term, tf, weight)`: the same for the cosine of TF-IDF vectors, before the query's length divides it."""
    terms = postings(chunks)
    n = chunks.agg(F.count("*")).scalar()
    value = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(value * value).over(Window.partitionBy("id")))
    return (terms.join(smooth_frequencies(terms, n), "term").withColumn("_norm", norm)
                 .select("id", "term", "tf", (F.col("idf") * value / F.col("_norm")).alias("weight")))


def smooth_frequencies(terms: DataFrame, n: Column | int) -> DataFrame:
    """`(term, idf)`, the smoothed inverse frequency of every term of the corpus."""
    n = n if isinstance(n, Column) else F.lit(n)
    return terms.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


@dataclass
class Index:
    """Stored tables. Chunks with the same products form a class, and classes are cut into groups.

    `postings`: `(block, term, cls, part, peak, items)`, one row for each term of a group: its largest weight and the
    `(place, weight)` of its chunks. `places`: `(block, cls, places)`, the chunks in corpus order. `scopes`: `(scope, allowed,
    classes)`, the classes a search may return, as a bitmap and as a list. Neither postings nor places grow with the
    number of products.
    """
    chunks: DataFrame
    postings: DataFrame
    places: DataFrame
    scopes: DataFrame
    products: list[str]
    n_blocks: int
    n_groups: int


#: Chunks of a group, and how many groups a query tries before it knows what a chunk must reach.
GROUP_CHUNKS = 64
SEED_GROUPS = 16


def _scopes(sets: list[tuple[int, list[str]]], products: list[str]) -> list[tuple[str, list[int], list[int]]]:
    """Every scope's classes. General chunks belong to every product's scope, so that a query looks in one scope."""
    general = {c for c, names in sets if GENERAL in names}
    named = {f"product:{p}": general | {c for c, names in sets if p in names} for p in products}
    out = []
    for scope, classes in {"any": {c for c, _ in sets}, "general": general, **named}.items():
        words = [0] * (len(sets) // 64 + 1)
        for c in classes:
            words[c // 64] |= 1 << c % 64
        out.append((scope, [w - (1 << 64) if w >> 63 else w for w in words], sorted(classes)))
    return out


def build_index(chunks: DataFrame, block_chunks: int = BLOCK_CHUNKS, limit: int = BROADCAST_LIMIT_BYTES,
                weights: Callable[[DataFrame], DataFrame] = bm25_weights, group_chunks: int = GROUP_CHUNKS) -> Index:
    """Weigh the corpus once and cut it into blocks that are small enough to broadcast.

    Document frequencies and mean length stay those of the whole corpus. The distinct product lists come to the driver: they
    are the label set, not data that grows.
    """
    spark = chunks.sparkSession
    named = chunks.select("id", "source", "title", "products", "text", "position")
    chunks = materialize(named.withColumn("product_set", F.array_sort(F.array_distinct(F.coalesce("products", F.array().cast("array<string>"))))), "chunks")
    found = sorted(r["product_set"] for r in chunks.select("product_set").distinct().collect())
    sets = list(enumerate(found))
    products = sorted({p for names in found for p in names if p != GENERAL})
    scopes = spark.createDataFrame(_scopes(sets, products), "scope string, allowed array<long>, classes array<int>")
    classes = F.broadcast(spark.createDataFrame(sets, "cls int, product_set array<string>"))
    placed = chunks.join(classes, "product_set").select("id", F.struct("source", "position", "id").alias("place"), "cls")
    weighted = materialize(placed.join(weights(chunks).select("id", "term", "weight"), "id").select("term", "cls", "place", "weight"), "weights")
    n = chunks.count()
    n_blocks = max(1, ceil(n / block_chunks), ceil(serialized_bytes(weighted) / limit))
    n_groups = max(1, ceil(n / n_blocks / group_chunks))
    code = F.xxhash64("place.id")
    block, part = F.pmod(code, F.lit(n_blocks)).cast("int"), F.pmod(F.shiftright(code, 32), F.lit(n_groups)).cast("int")
    postings = weighted.groupBy(block.alias("block"), "term", "cls", part.alias("part")).agg(
        F.max("weight").alias("peak"), F.collect_list(F.struct("place", "weight")).alias("items"))
    places = placed.groupBy(block.alias("block"), "cls").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return Index(chunks.drop("product_set"), materialize(postings, "postings"), materialize(places, "places"), materialize(scopes, "scopes"),
                 products, n_blocks, n_groups)


def search_scope(product: Column, index: Index) -> Column:
    """Where a query looks: no product means everywhere, an unlisted one the general chunks."""
    listed = F.array(*[F.lit(p) for p in index.products]) if index.products else F.array().cast("array<string>")
    return (F.when(product.isNull() | (product == ""), "any")
             .when(F.array_contains(listed, product), F.concat(F.lit("product:"), product))
             .otherwise("general"))


def _scoped(queries: DataFrame, index: Index, product: str | None) -> DataFrame:
    """`(query_id, text, scope)`, partitioned by query."""
    p = F.col(product) if product else F.lit(None).cast("string")
    return spread(queries.select("query_id", "text", search_scope(p, index).alias("scope")), "query_id")


def _terms(queries: DataFrame, index: Index) -> DataFrame:
    """`(query_id, scope, term, qtf, allowed)`; a query without a term keeps one row. One row per scope is broadcast."""
    terms = (queries.select("query_id", "scope", F.explode_outer(search_tokens(F.col("text"))).alias("term"))
                    .groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf")))
    return terms.join(F.broadcast(index.scopes.select("scope", "allowed")), "scope", "left")


#: Whether the scope's bitmap has the class.
_IN_SCOPE = "getbit(get(allowed, cast(cls div 64 as int)), cls % 64) = 1"


def _block(index: Index, block: int, *columns: str) -> DataFrame:
    return F.broadcast(index.postings.filter(F.col("block") == block).select(F.col("term").alias("posted"), *columns))


def _scored(queries: DataFrame, index: Index, block: int) -> DataFrame:
    """`(query_id, scope, place, score)` for chunks of the block that share a term with the query.

    A query also has one row without a place, for its terms that hit nothing, so none gets lost.
    """
    hit = (F.col("term") == F.col("posted")) & F.expr(_IN_SCOPE)
    found = _terms(queries, index).join(_block(index, block, "cls", "items"), hit, "left")
    return (found.select("query_id", "scope", "qtf", F.inline_outer("items"))
                 .groupBy("query_id", "scope", "place").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score")))


def matched_groups(queries: DataFrame, index: Index, block: int) -> DataFrame:
    """`(query_id, term, qtf, cls, part, size, bound, turn)`: the query's terms in every group of its scope.

    `bound` is what no chunk of the group exceeds: the sum of its terms' peaks. `turn` ranks the query's groups by it.
    """
    heads = _block(index, block, "cls", "part", "peak", F.size("items").alias("size"))
    rows = _terms(queries, index).join(heads, (F.col("term") == F.col("posted")) & F.expr(_IN_SCOPE))
    group = Window.partitionBy("query_id", "cls", "part")
    rows = rows.withColumn("bound", F.sum(F.col("qtf") * F.greatest("peak", F.lit(0.0))).over(group))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cls", "part")
    return rows.select("query_id", "scope", "term", "qtf", "cls", "part", "size", "bound", F.dense_rank().over(order).alias("turn"))


def needed_groups(queries: DataFrame, index: Index, block: int, k: int, seeds: int = SEED_GROUPS) -> tuple[DataFrame, DataFrame]:
    """The groups that may hold one of the best `k` chunks, in two parts: those tried first, and those whose bound isn't
    below the k-th best score that the first ones gave. Equal scores stay in."""
    groups = materialize(matched_groups(queries, index, block), "groups")
    first = groups.filter(F.col("turn") <= seeds)
    reached = _group_scores(first, index, block).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    least = reached.select("query_id", F.get("s", F.lit(k - 1)).alias("least")).filter("least > 0")
    # The same slack as in comparing scores: what rounds to the same score isn't left out.
    slack = F.col("least") * (1 - 1e-9) - 10.0 ** -SCORE_DIGITS
    rest = groups.filter(F.col("turn") > seeds).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= slack))
    return first, rest.drop("least")


def _group_scores(groups: DataFrame, index: Index, block: int) -> DataFrame:
    items = _block(index, block, F.col("cls").alias("c"), F.col("part").alias("g"), "items")
    hit = (F.col("term") == F.col("posted")) & (F.col("cls") == F.col("c")) & (F.col("part") == F.col("g"))
    return (groups.join(items, hit).select("query_id", "scope", "qtf", F.inline("items"))
                  .groupBy("query_id", "scope", "place").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score")))


def _pruned(queries: DataFrame, index: Index, block: int, k: int, seeds: int) -> DataFrame:
    """`_scored` without chunks that can't be among the best `k`."""
    first, rest = needed_groups(queries, index, block, k, seeds)
    none = queries.select("query_id", "scope", F.lit(None).cast(index.postings.schema["items"].dataType.elementType["place"].dataType).alias("place"),
                          F.lit(None).cast("double").alias("score"))
    scores = reduce(DataFrame.unionByName, [none, _group_scores(first, index, block), _group_scores(rest, index, block)])
    return spread(scores, "query_id")


def _one_by_one(part: Callable[[int], DataFrame], index: Index) -> list[DataFrame]:
    """Store the result of every block before the next one is broadcast, so that one block at a time is held."""
    return [part(0)] if index.n_blocks == 1 else [materialize(part(b), "block") for b in range(index.n_blocks)]


def bm25_scores(queries: DataFrame, index: Index, product: str | None = "product") -> DataFrame:
    """`(query_id, id, score)` of all chunks that share a term with the query, unranked."""
    q = _scoped(queries, index, product)
    parts = _one_by_one(lambda b: _scored(q, index, b), index)
    hits = reduce(DataFrame.unionByName, parts).filter("place is not null")
    return hits.select("query_id", F.col("place.id").alias("id"), "score")


# Scores are compared at this many digits, so that equal scores summed in another order stay tied.
SCORE_DIGITS = 9


def _entry(place: Column, score: Column) -> Column:
    return F.struct((-F.round(score, SCORE_DIGITS)).alias("o"), place.alias("place"), score.alias("score"))


def _arrays(index: Index, block: int) -> Block:
    """A block's postings as arrays. It is small enough to broadcast, and goes to the tasks the same way, through the driver."""
    by_place = Window.partitionBy("block")
    slots = (index.places.filter(F.col("block") == block).select("block", "cls", F.explode("places").alias("place")).distinct()
             .select("cls", "place", (F.dense_rank().over(by_place.orderBy("place")) - 1).alias("at"),
                     (F.row_number().over(by_place.orderBy("place", "cls")) - 1).alias("slot")))
    posted = index.postings.filter(F.col("block") == block).select("term", "cls", F.inline("items"))
    posted = posted.join(F.broadcast(slots.select("cls", "place", "slot")), ["cls", "place"])
    return Block.of(slots.toArrow(), posted.select("term", "slot", "weight").toArrow())


def _counted_top(queries: DataFrame, index: Index, block: int, k: int) -> DataFrame:
    """`(query_id, best)`: the best `k` candidates of a block as one array, chunks without a shared term included.

    Texts are scored as they pass by; nothing is exchanged and no token becomes a row.
    """
    texts = queries.join(F.broadcast(index.scopes.select("scope", "allowed")), "scope", "left")
    texts = texts.select("query_id", "scope", "allowed", F.col("text").cast("binary").alias("text")).sortWithinPartitions("query_id")
    place = index.postings.schema["items"].dataType.elementType["place"].dataType
    entry = T.StructType([T.StructField("o", T.DoubleType()), T.StructField("place", place), T.StructField("score", T.DoubleType())])
    schema = T.StructType([queries.schema["query_id"], T.StructField("best", T.ArrayType(entry))])
    return texts.mapInArrow(best_of(_arrays(index, block), k, SCORE_DIGITS), schema)


def _block_top(queries: DataFrame, index: Index, block: int, k: int, seeds: int) -> DataFrame:
    """`_counted_top` for a block of many groups, most of which are left out.

    Chunks without a shared term have score 0 and come in corpus order; the first `k + matched` candidates of a class hold at least `k` of
    them, or all there are. A query with `k` positive scores needs none, so only the others look at them, and
    groups are left out only for a query that has `k` positive scores.
    """
    scored = _pruned(queries, index, block, k, seeds)
    hit = F.when(F.col("place").isNotNull(), _entry(F.col("place"), F.col("score")))
    hits = scored.groupBy("query_id", "scope").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    short = (F.size("hits") < k) | (F.get("hits", F.lit(k - 1))["score"] <= 0)
    rows = hits.join(F.broadcast(index.scopes.select("scope", "classes")), "scope", "left")
    rows = rows.select("query_id", "hits", F.explode_outer(F.when(short, F.col("classes"))).alias("of"))
    places = F.broadcast(index.places.filter(F.col("block") == block).select("cls", "places"))
    first = F.slice("places", F.lit(1), F.lit(k) + F.size("hits"))
    rows = (rows.join(places, F.col("of") == F.col("cls"), "left")
                .groupBy("query_id").agg(F.any_value("hits").alias("hits"), F.array_sort(F.flatten(F.collect_list(first))).alias("first")))
    rest = F.slice(F.array_except("first", F.transform("hits", lambda x: x["place"])), 1, k)
    zeros = F.transform(rest, lambda p: _entry(p, F.lit(0.0)))
    return rows.select("query_id", F.slice(F.array_sort(F.concat("hits", zeros)), 1, k).alias("best"))


def search(queries: DataFrame, index: Index, k: int = 4, product: str | None = "product", seeds: int = SEED_GROUPS) -> DataFrame:
    """`(query_id, rank, id, score)`: the best `k` candidates by score, equal ones in corpus order.

    In a corpus of more than `seeds` groups, a query first scores its most promising groups, and then only those that can
    still reach its `k`-th best score.
    """
    q = _scoped(queries, index, product)
    top = (lambda b: _counted_top(q, index, b, k)) if index.n_groups <= seeds else (lambda b: _block_top(q, index, b, k, seeds))
    tops = _one_by_one(top, index)
    best = tops[0]
    if len(tops) > 1:
        # Partitioned again by name: a union need not keep what its parts share.
        merged = (spread(reduce(DataFrame.unionByName, tops), "query_id")
                  .groupBy("query_id").agg(F.flatten(F.collect_list("best")).alias("best")))
        best = merged.select("query_id", F.slice(F.array_sort("best"), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("b.place.id").alias("id"), F.col("b.score").alias("score"))


def candidate_counts(queries: DataFrame, index: Index, product: str | None = "product") -> DataFrame:
    """`(query_id, n_candidates)`: how many chunks the product filter leaves each query."""
    per_class = index.places.groupBy("cls").agg(F.sum(F.size("places")).alias("n"))
    sizes = (index.scopes.select("scope", F.explode("classes").alias("cls")).join(F.broadcast(per_class), "cls")
                  .groupBy("scope").agg(F.sum("n").alias("n_candidates")))
    p = F.col(product) if product else F.lit(None).cast("string")
    scoped = queries.select("query_id", search_scope(p, index).alias("scope"))
    # One row per product name.
    return scoped.join(F.broadcast(sizes), "scope", "left").select(
        "query_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def cosine_search(queries: DataFrame, index: Index, k: int = 4, product: str | None = "product") -> DataFrame:
    """`search` over an index of `cosine_weights`, with cosines as scores: same ids, filter and order of equals."""
    terms = postings(index.chunks)
    idf = smooth_frequencies(terms, index.chunks.agg(F.count("*")).scalar())
    asked = (spread(queries.select("query_id", "text"), "query_id").select("query_id", F.explode(search_tokens(F.col("text"))).alias("term"))
             .groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    value = F.col("qtf") * F.col("idf")
    norms = asked.join(idf, "term").groupBy("query_id").agg(F.sqrt(F.sum(value * value)).alias("_norm"))
    hits = search(queries, index, k, product).join(norms, "query_id", "left")
    return hits.select("query_id", "rank", "id", F.coalesce(F.col("score") / F.col("_norm"), F.lit(0.0)).alias("score"))


# Rows of a block of queries and of vectors, and queries whose scores are looked at together.
VECTOR_BLOCK, VECTOR_STRIP = 4096, 256


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 4, block: int = VECTOR_BLOCK) -> DataFrame:
    """`(query_id, rank, id, score)` by cosine over `(query_id, embedding)` and `(id, embedding)`, ids of any type.

    Exact: every block of queries meets every block of vectors in a task of its own, which holds `block` rows of
    each and emits `k` rows per query. Nothing goes through the driver.
    """
    def dealt(df: DataFrame, key: str, own: str, other: str, mine: int, others: int) -> DataFrame:
        row = df.select(key, F.col("embedding").cast("array<double>").alias(f"{key}_vector"),
                        F.pmod(F.xxhash64(key), F.lit(mine)).cast("int").alias(own))
        return row.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    n_q, n_v = (max(1, ceil(df.count() / block)) for df in (queries, chunks))
    left = dealt(queries, "query_id", "qb", "vb", n_q, n_v)
    right = dealt(chunks, "id", "vb", "qb", n_v, n_q)
    schema = T.StructType([left.schema["query_id"], right.schema["id"], T.StructField("score", T.DoubleType())])
    scored = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(_nearest(k), schema)
    rank = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", SCORE_DIGITS)), "id")
    return (scored.withColumn("rank", F.row_number().over(rank))
            .filter(F.col("rank") <= k).select("query_id", "rank", "id", "score"))


def _nearest(k: int):
    def unit(column: pd.Series) -> np.ndarray:
        matrix = np.stack(column.to_numpy())
        return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("id")
        if queries.empty or chunks.empty:
            return pd.DataFrame({"query_id": queries["query_id"][:0], "id": chunks["id"][:0], "score": np.zeros(0)})
        asked, vectors = unit(queries["query_id_vector"]), unit(chunks["id_vector"]).T
        parts = [_best(asked[i:i + VECTOR_STRIP] @ vectors, k) for i in range(0, len(asked), VECTOR_STRIP)]
        best, scores = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"query_id": np.repeat(queries["query_id"].to_numpy(), best.shape[1]),
                             "id": chunks["id"].to_numpy()[best.ravel()], "score": scores.ravel()})
    return run


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores of each row's best `k`, equal ones in the order of places; NaN comes last.

    Only what reaches the `k`-th best score after rounding is sorted.
    """
    k = min(k, scores.shape[1])
    rank = np.where(np.isnan(scores), -np.inf, scores) if np.isnan(scores).any() else scores
    least = np.round(np.partition(rank, -k, axis=1)[:, -k], SCORE_DIGITS)
    row, place = np.nonzero(rank >= (least - 10.0 ** -SCORE_DIGITS)[:, None])
    order = np.lexsort((place, -np.round(rank[row, place], SCORE_DIGITS), row))
    starts = np.searchsorted(row, np.arange(len(scores)))
    best = place[order][starts[:, None] + np.arange(k)]
    return best, np.take_along_axis(scores, best, axis=1)
