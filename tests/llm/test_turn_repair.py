import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from textroute.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, part string, uid string"
SPACE = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, edits, lines) by a search over (rows read, pattern state), shortest first and ASCII-least among equals."""
    faults = plain_faults(rows)
    queue, done = [(0, "", 0, "", ())], {}
    while queue:
        cost, edits, at, made, lines = heapq.heappop(queue)
        if at == len(rows) and (made == "" or made[-1] == "a"):
            return cost, edits, lines
        if done.setdefault((at, made[-1:]), (cost, edits)) != (cost, edits):
            continue
        want = {"": "us", "s": "u", "u": "a", "a": "u"}[made[-1:]]
        step = lambda c, e, i, m, more: heapq.heappush(queue, (cost + c, edits + e, at + i, m, lines + more))
        new = {"u": "user", "a": "assistant"}[want[0]]
        step(3, "I", 0, made + want[0], (f"{new}:",))
        if at < len(rows):
            (role, text), fault = rows[at], faults[at]
            step(4, "D", 1, made, ())
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                step(3 + extra, "R", 1, made + want[0], (f"{new}:{text}",))
                if role[:1] and role[:1] in want:
                    step(extra, "K", 1, made + role[0], (f"{role}:{text}",))
    raise AssertionError


def expected(rows):
    """Report of each conversation of `(conv_id, turn, role, text)` in the order of turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}:{r[2]}".encode()).digest()))
        turns, pairs = [t for t, _, _ in mine if t is not None], [(r, x) for _, r, x in mine]
        cost, edits, lines = plain_repair(pairs)
        faults = plain_faults(pairs)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:])), cost, edits,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, block=tr.FIRST_BLOCK):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return {r[0]: tuple(r)[1:] for r in tr.report(tr.repair(df, first_block=block), df).collect()}


def random_rows(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "a", "up"]
    texts = ["Hi.", "Yes!", "No?\n", "cut", "cut off ", "", " \t", None, "dot. then", "Ω."]
    turns = [rng.choice([None, *range(n)]) if rng.random() < .2 else i for i in range(n)]
    return [(conv, t, rng.choice(roles), rng.choice(texts) if rng.random() < .5 else f"text {rng.random()}{rng.choice(['.', ''])}") for t in turns]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_equals_a_search_over_all_edits(spark, block):
    rng = random.Random(block)
    rows = [r for conv in range(60) for r in random_rows(rng, conv, rng.randrange(1, 14))] + random_rows(rng, None, 9) + random_rows(rng, 1000, 120)
    assert run(spark, rows, block) == expected(rows)


def test_one_block_and_many_agree():
    rng = random.Random(4)
    for _ in range(300):
        codes = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 12)))
        whole = tr.walk(codes, tr.END, tr.START, True)
        cut = rng.randrange(len(codes) + 1)
        mid = tr.END
        for c in reversed(codes[cut:]):
            mid = tr.back(c, mid)
        assert tr.through(tr.transfer(codes[cut:]), tr.END) == mid
        state, a, x = tr.walk(codes[:cut], mid, tr.START, False)
        _, b, y = tr.walk(codes[cut:], tr.END, state, True)
        assert (a + b, x + y) == whole[1:]


def test_a_long_conversation_is_cut_into_roots_of_its_length(spark):
    n = 4000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(n)] + [(2, 0, "user", "?")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    found = tr.repair(df)
    blocks = found.blocks.filter("conv_id = 1").collect()
    assert len({b.part for b in blocks}) > 1  # more than one task has a share
    assert len(blocks) <= 4 * (2 * n) ** .5 and max(len(b.audit) for b in blocks) <= 64 + (2 * n) ** .5
    assert [r.cost for r in tr.report(found, df).orderBy("conv_id").collect()] == [0, 3]


def test_copies_of_one_turn_spread_and_count_once(spark):
    rows = [(1, 5, "user", "Same.")] * 500 + [(1, 6, "assistant", "Fine.")]
    got = run(spark, rows)
    assert got[1][:6] == (0, 0, 499, 0, 499, 4 * 499)
    assert got[1][6].count("K") == 2


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(7, None, None, None)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in tr.damaged(df).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if fate:
            want += [(c, t, "user" if fate == 4 else r, "" if fate == 1 else x.translate({ord(m): None for m in ".!?"}) if fate == 2 else x)] * (2 if fate == 3 else 1)
    assert got == sorted(want, key=str)


def test_empty_tables_and_conversations_that_vanish(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert run(spark, []) == {}
    ids = spark.createDataFrame([(4, 0, "user", "", "", "")], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in tr.report(tr.repair(none), ids).collect()] == [(4, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert [tuple(r) for r in tr.report(tr.repair(ids), ids).collect()] == [(4, 0, 1, 0, 0, 0, 4, "D", nothing)]


def test_edits_hold_the_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "A.", "", ""), (1, 1, "tool", "B", "", ""), (1, 2, "user", "", "", "")], SCHEMA)
    edits = tr.repair(df).edits.orderBy("part", "seq", "step").select("edit", "turn", "role", "text").collect()
    assert "".join(e.edit for e in edits) == plain_repair([("assistant", "A."), ("tool", "B"), ("user", "")])[1]
    assert [e.role for e in edits if e.edit != "D"] == ["user", "assistant"]
    assert tr.repair(df).edits.filter(F.col("edit") == "D").count() == [e.edit for e in edits].count("D")
