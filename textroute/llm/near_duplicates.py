"""SimHash near duplicates, found through signatures with one deleted bit.

A 64-bit fingerprint is cut into two segments. Fingerprints that differ in at most three bits have a
segment in which they differ in at most one, so they share one of its 32 variants with one bit
deleted. Each distinct fingerprint is indexed under its 64 variants; an equality join finds the
candidates and the whole distance verifies them. Equal texts collapse before that.

A signature that many distinct fingerprints share (a large family of near copies) isn't joined with
itself. There, links go through keys that delete further bits: two fingerprints of a family link
exactly if they share such a key, and each key's fingerprints are tied to its smallest one. The work
is linear in the family and loses no connection.

Joins of exploded rows ask for a sort-merge: Spark takes them for as small as the rows before, and would broadcast them.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textroute.llm.components import connected_components
from textroute.llm.registry import query, table
from textroute.session import materialize

HALF = 32
LOW = (1 << HALF) - 1
RADIUS = 3
#: A signature of more distinct fingerprints is linked through deletion keys instead of pairs.
FAMILY = 512
SHINGLE = 3
SEED = 42
#: Shingles counted at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 17


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles; 0 for a text without a word, or null."""
    import re
    from functools import partial

    import numpy as np
    import xxhash

    words = re.findall(r"[^ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = map(" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([" ".join(words)])
    total, ones = max(1, len(words) - SHINGLE + 1), np.zeros(64, np.int64)
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), grams)
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        block = np.fromiter(hashes, np.uint64, n)
        ones += np.unpackbits(block.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def signatures(fps: DataFrame) -> DataFrame:
    """`(fp, seg, bit, rest)`, 64 rows for each distinct fingerprint."""
    slots = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1))).alias("slot"))
    return slots.select(
        "fp", F.expr(f"cast(slot div {HALF} as int)").alias("seg"), F.expr(f"cast(slot % {HALF} as int)").alias("bit"),
        F.expr(f"(shiftrightunsigned(fp, cast(slot div {HALF} as int) * {HALF}) & {LOW}L) & ~shiftleft(1L, cast(slot % {HALF} as int))")
        .alias("rest"))


def _plain_links(sigs: DataFrame, hot: DataFrame) -> DataFrame:
    """Verified pairs within signatures that aren't hot, each pair from one signature only."""
    key = ["seg", "bit", "rest"]
    left = sigs.join(hot, key, "left_anti")
    right = left.select(F.col("fp").alias("other"), *key)
    seg = lambda x, s: f"(shiftrightunsigned({x}, {s} * {HALF}) & {LOW}L)"
    near = f"bit_count({seg('fp ^ other', 'seg')})"
    # Equal segments meet under every deleted bit: the first counts. A pair near in both segments meets in both: the lower counts.
    once = f"({near} = 1 or bit = 0) and (seg = 0 or bit_count({seg('fp ^ other', 0)}) > 1)"
    return (left.join(right.hint("merge"), key).filter(f"fp < other and bit_count(fp ^ other) <= {RADIUS} and {once}")
            .select("fp", "other"))


def _family_links(sigs: DataFrame, hot: DataFrame) -> DataFrame:
    """Ties within hot signatures, without pairs.

    Under the first deleted bit, segments that are equal in full may differ in three bits of the other segment: they
    share a key that deletes these three. Segments that differ in the deleted bit leave two. Both keys hold
    fingerprints within the radius only.
    """
    members = sigs.join(hot, ["seg", "bit", "rest"], "left_semi").selectExpr(
        "fp", "seg", "bit", "rest", f"shiftrightunsigned(fp, (1 - seg) * {HALF}) & {LOW}L as far",
        f"shiftrightunsigned(fp, seg * {HALF}) & {LOW}L as near")
    i = members.select("*", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("i"))
    ij = i.select("*", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("j")).filter("i < j")
    two = ij.selectExpr("fp", "seg", "bit", "rest as fixed", "far & ~(shiftleft(1L, i) | shiftleft(1L, j)) as left_over",
                        f"i * {HALF} + j as mask")
    ijk = ij.filter("bit = 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("k")).filter("j < k")
    three = ijk.selectExpr("fp", "seg", "-1 as bit", "near as fixed",
                           "far & ~(shiftleft(1L, i) | shiftleft(1L, j) | shiftleft(1L, k)) as left_over",
                           f"(i * {HALF} + j) * {HALF} + k as mask")
    keyed = two.unionByName(three)
    key = ["seg", "bit", "fixed", "left_over", "mask"]
    first = keyed.groupBy(*key).agg(F.min("fp").alias("other"), F.max("fp").alias("last")).filter("other < last").drop("last")
    return keyed.join(first.hint("merge"), key).filter("fp != other").select("fp", "other").distinct()


def links(fps: DataFrame, family: int = FAMILY) -> DataFrame:
    """Edges `(fp, other)` between distinct fingerprints, with the components of all pairs within three bits."""
    sigs = signatures(fps)
    hot = materialize(sigs.groupBy("seg", "bit", "rest").count().filter(F.col("count") > family).drop("count"), "families")
    edges = _plain_links(sigs, hot)
    return edges if hot.isEmpty() else edges.unionByName(_family_links(sigs, hot))


def components(docs: DataFrame, family: int = FAMILY) -> DataFrame:
    """`(fp, root, first_id, component_id)` of each distinct fingerprint of a stored `(doc_id, fp)` table."""
    fps = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = materialize(connected_components(links(fps.select("fp"), family), "fp", "other"), "roots")
    linked = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return linked.join(least, "root").select("fp", "root", "first_id", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", family: int = FAMILY) -> DataFrame:
    """Each document's fingerprint and component: `(doc_id, fingerprint, component_id)`, one row for each input row.

    A null or empty text has no word: fingerprint zero, linked like any other. Rows whose id is null take part; the
    component is the smallest id that isn't null, or null if there is none. Repeated rows are returned as often as
    they come; an empty table gives an empty table. Other columns are not read.
    """
    docs = materialize(df.select(F.col(doc_id).alias("doc_id"), fingerprint_udf(F.col(text)).alias("fp")), "simhash")
    found = components(docs, family).select(F.col("fp").alias("found"), "component_id")
    return docs.join(found, F.col("fp") == F.col("found"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", family: int = FAMILY) -> DataFrame:
    """The rows of `df`, one document of each component: the one with the smallest id, or a null id if there is no other.

    Of several texts under that id, the one with the smallest fingerprint stays, and of repeated rows one. Wordless and null
    texts are copies of each other. The columns of `df` are kept as they are.
    """
    docs = materialize(df.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint_udf(F.col(f"`{text}`")).alias("fp"),
                                 F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), "simhash-rows")
    kept = (components(docs.select("doc_id", "fp"), family).filter(F.col("first_id").eqNullSafe(F.col("component_id")))
            .groupBy("root", F.col("component_id").alias("kept_id")).agg(F.min("fp").alias("kept_fp")))
    found = docs.join(kept, (F.col("fp") == F.col("kept_fp")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return found.dropDuplicates(["fp", "doc_id"]).select("row.*")


@query("op7_simhash_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its SimHash and near-duplicate component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
