"""SimHash fingerprints of bags of hashes and a multi-index of their blocks, as column expressions.

Copies of one shingle in a bag are numbered, so that a bag is a set of (shingle, number) and every pair of bags with
weighted similarity `t` differs in a bit with the same probability. `radius` derives the distance to search from it.

With `B` blocks two fingerprints within `2 * B - 1` bits have a block that differs in one bit at most: one side is
indexed under each block's value and all values one bit away, the other looks its own values up. That finds every
pair within the radius.
"""
from __future__ import annotations

from math import acos, ceil, pi, sqrt
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64
DEVIATIONS = 5


def radius(threshold: float) -> int:
    """Bits within which pairs of weighted similarity `threshold` lie: the mean plus five standard deviations.

    Bags of similarity `t` have a cosine of `2t / (1 + t)` at least, and random signs differ with probability angle / pi.
    At 0.8 this is 25 bits; a pair of just that similarity lies beyond with probability below one in a million.
    """
    p = acos(min(1.0, 2 * threshold / (1 + threshold))) / pi
    return min(BITS, ceil(BITS * p + DEVIATIONS * sqrt(BITS * p * (1 - p))))


def block_count(bits: int) -> int:
    """The fewest blocks that give any two fingerprints within `bits` a block with one bit of difference at most."""
    return min(BITS, bits // 2 + 1)


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each block."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(bag: Column) -> Column:
    """SimHash of a sorted array of hashes: a bit is set if it is in more than half of them, copies numbered; 0 for none.

    The counts of bits `g` and `g + 32` share a long, so that 32 sums count all 64 bits.
    """
    pair = F.lit((1 << 32) + 1)

    def step(s: Column, h: Column) -> Column:
        number = F.when(s["h"].eqNullSafe(h), s["number"]).otherwise(0) + 1

        def count(n: Column) -> Column:
            return let(F.xxhash64(h, n), lambda code: F.struct(h.alias("h"), n.alias("number"), F.transform(
                s["sums"], lambda c, g: c + F.call_function("shiftright", code, g).bitwiseAND(pair)).alias("sums")))
        return let(number, count)

    def bits(sums: Column, size: Column) -> Column:
        def of_pair(c: Column, g: Column) -> Column:
            low = F.when(c.bitwiseAND(F.lit((1 << 32) - 1)) * 2 > size, F.call_function("shiftleft", _long(1), g)).otherwise(_long(0))
            high = F.when(F.shiftrightunsigned(c, 32) * 2 > size, F.call_function("shiftleft", _long(1), g + 32)).otherwise(_long(0))
            return low.bitwiseOR(high)
        return F.aggregate(F.transform(sums, of_pair), _long(0), lambda x, y: x.bitwiseOR(y))

    zero = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("number"), F.array_repeat(_long(0), 32).alias("sums"))
    return F.aggregate(bag, zero, step, lambda s: bits(s["sums"], F.size(bag)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _values(code: Column, blocks: int) -> list[Column]:
    return [F.shiftrightunsigned(code, at).bitwiseAND(_long((1 << bits) - 1)) for at, bits in _cuts(blocks)]


def looked_up(code: Column, blocks: int) -> Column:
    """`(block, value)` for each block of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(_values(code, blocks))])


def indexed(code: Column, blocks: int) -> Column:
    """`(block, value)` for each block of a fingerprint and each value at most one bit away."""
    return F.array(*[F.struct(F.lit(i).alias("block"), near.alias("value"))
                     for i, (v, (_, bits)) in enumerate(zip(_values(code, blocks), _cuts(blocks)))
                     for near in (v, *(v.bitwiseXOR(_long(1 << bit)) for bit in range(bits)))])


def first_block(a: Column, b: Column, blocks: int) -> Column:
    """The first block in which two fingerprints differ in one bit at most: a pair is kept there alone."""
    both = a.bitwiseXOR(b)
    return F.coalesce(*[F.when(F.bit_count(both.bitwiseAND(_long(((1 << bits) - 1) << at))) <= 1, F.lit(i))
                        for i, (at, bits) in enumerate(_cuts(blocks))])
