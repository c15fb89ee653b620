"""Bounded samples of labelled rows, the same however the table is stored."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAIN = 1_000_000


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text leaves `part` when divided by `parts`; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def bounded_sample(df: DataFrame, kind: str, key: Column, size: int) -> DataFrame:
    """At most `size` rows of each value of `kind`, those with the smallest hash of `key`.

    The kinds, a few by nature, are counted; a hash below twice the wanted share passes the scan, and a ranked
    cut, which Spark applies in each task before the exchange, leaves the exact number.
    """
    counts = {r[kind]: r["n"] for r in df.groupBy(kind).agg(F.count("*").alias("n")).collect() if r[kind] is not None}
    if not counts:
        return df.filter(F.lit(False))
    share = reduce(lambda e, kn: e.when(F.col(kind) == kn[0], min(GRAIN, -(-2 * size * GRAIN // kn[1]))), counts.items(), F.when(F.lit(False), 0))
    code, rank = "__sample_code", "__sample_rank"
    return (df.withColumn(code, F.xxhash64(key, F.lit("sample"))).filter(F.pmod(F.col(code), F.lit(GRAIN)) < share)
            .withColumn(rank, F.row_number().over(Window.partitionBy(kind).orderBy(code)))
            .filter(F.col(rank) <= size).drop(rank, code))
