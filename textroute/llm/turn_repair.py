"""Cheapest repair of conversations by checkpointed dynamic programming.

A repaired conversation reads `(s?(ua)+)?` by the initials of its roles. Turns may be kept, given another role or deleted,
and empty turns may be inserted. A state is the place in that pattern; the least cost of finishing from each state is a
vector of four numbers that one turn carries backward.

1. Turns are sorted over all tasks by conversation and turn, so a long conversation spreads over many of them. Each run of a
   conversation within a task is cut into blocks whose length grows by one from block to block: some sqrt(2n) blocks of
   at most that length, without knowing n. A block's costs compose to a 4 x 4 min-plus matrix.
2. Backward over the matrices of a conversation, the state-cost vector at the end of each block is found. These are the
   only vectors that are stored: the checkpoints.
3. Every block recomputes its inner vectors from its checkpoint and walks forward, taking the ASCII-least edit that is still
   cheapest. It does so from each state it may be entered in; a pass over the blocks' exits picks the one that is.

A fold over a conversation's blocks takes in as many rows as the square root of its turns, never the turns themselves.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textroute.llm.registry import query, table
from textroute.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns of a run's first block; each later one has one more.
FIRST_BLOCK = 64
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
INITIAL = {USER: "u", ASSISTANT: "a"}
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = float("inf")
#: What a turn looks like to the edits: its initial (upper case if truncated), `o` or `O` for any other, `x` if it must go.
SPACE = " \t\n\x0b\x0c\r"

Costs = tuple[float, float, float, float]


def with_inserts(v: Costs) -> Costs:
    """The least costs if turns may be inserted first."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return (min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant)


END: Costs = with_inserts((0, NEVER, NEVER, 0))


def kept_state(code: str, state: int) -> int | None:
    """The state after keeping a turn, None if it doesn't fit."""
    letter = code.lower()
    if letter == "s" and state == START:
        return SYSTEM
    return FOLLOWS[state] if INITIAL[FOLLOWS[state]] == letter else None


@lru_cache(maxsize=1 << 16)
def _back(code: str, after: Costs) -> Costs:
    """Least costs before a turn, given those after it."""
    if code == "x":
        return with_inserts(tuple(DELETE + c for c in after))
    extra, out = TRUNCATED if code.isupper() else 0, []
    for state in range(4):
        kept = kept_state(code, state)
        out.append(min(DELETE + after[state], REROLE + extra + after[FOLLOWS[state]],
                       NEVER if kept is None else KEEP + extra + after[kept]))
    return with_inserts(tuple(out))


def back(code: str, after: Costs) -> Costs:
    """The same; what is remembered doesn't depend on the absolute costs, so a few vectors serve all conversations."""
    least = min(after)
    return tuple(least + c for c in _back(code, tuple(c - least for c in after)))


def transfer(codes: str) -> list[float]:
    """Least costs through a block, from each state (row) to each (column), row by row."""
    columns = []
    for state in range(4):
        v = tuple(0 if s == state else NEVER for s in range(4))
        for code in reversed(codes):
            v = back(code, v)
        columns.append(v)
    return [columns[j][i] for i in range(4) for j in range(4)]


def through(matrix: list[float], after: Costs) -> Costs:
    return tuple(min(matrix[4 * i + j] + after[j] for j in range(4)) for i in range(4))


def walk(codes: str, end: Costs, state: int, last: bool) -> tuple[int, str, int]:
    """State after a block, its edits and their cost; the last block also finishes the conversation.

    Of the cheapest edits, the ASCII-least are taken: delete, insert, keep, then another role.
    """
    vectors = [end]
    for code in reversed(codes):
        vectors.append(back(code, vectors[-1]))
    vectors.reverse()
    edits, at, cost = [], 0, 0
    while at < len(codes) or last and not (state in (START, ASSISTANT)):
        here = vectors[at][state]
        if at < len(codes) and DELETE + vectors[at + 1][state] == here:
            edits.append("D")
            at, cost = at + 1, cost + DELETE
        elif at == len(codes) or INSERT + vectors[at][FOLLOWS[state]] == here:
            edits.append("I")
            state, cost = FOLLOWS[state], cost + INSERT
        else:
            extra, kept = TRUNCATED if codes[at].isupper() else 0, kept_state(codes[at], state)
            if kept is not None and KEEP + extra + vectors[at + 1][kept] == here:
                edits.append("K")
                state, cost = kept, cost + KEEP + extra
            else:
                edits.append("R")
                state, cost = FOLLOWS[state], cost + REROLE + extra
            at += 1
    return state, "".join(edits), cost


def lawful(initials: str) -> bool:
    return initials in ("su", "ua", "au")


def faults(turns: DataFrame) -> DataFrame:
    """Adds each turn's `fault`: blank, duplicate, truncated, or null. `turns` is a stored `(conv_id, turn, role, text, uid, digest)`.

    Repeated turns are found by the first turn of each role and text, an aggregate that a hot conversation or text
    doesn't gather in one task.
    """
    blank = ~F.col("text").rlike(r"[^ \t-\r]")
    first = turns.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "uid")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.uid").alias("first_uid"))
    joined = turns.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").drop("c", "d")
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    return joined.withColumn("fault", F.when(blank, "blank").when(F.col("first_uid") != F.col("uid"), "duplicate")
                             .when(~last.isin(".", "!", "?"), "truncated")).drop("first_uid")


def edit_code(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(code)).otherwise(code)


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


INT, LONG, TEXT, NUMBERS = T.IntegerType(), T.LongType(), T.StringType(), T.ArrayType(T.DoubleType())
BLOCK = _fields(part=INT, seq=LONG, codes=TEXT, initials=TEXT, uids=T.ArrayType(LONG), costs=NUMBERS)
CHECKPOINT = _fields(part=INT, seq=LONG, after=NUMBERS, is_last=T.BooleanType(), seam=INT)
ENTRY = _fields(part=INT, seq=LONG, state=INT)
WALK = _fields(exits=T.ArrayType(INT), audits=T.ArrayType(TEXT), costs=T.ArrayType(INT), unlawful=INT)
EDIT = _fields(step=INT, edit=TEXT, uid=LONG, new_role=TEXT)


def _cut(batches: Iterator[pa.RecordBatch], first_block: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns `(conv_id, code, initial, uid)` of a task to blocks, holding one block at a time."""
    part, seq, length = TaskContext.get().partitionId(), 0, first_block
    names = ["conv_id", *BLOCK.names]
    types = [None, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    codes, initials, uids, conv, out = [], [], [], None, []

    def close() -> None:
        nonlocal seq
        joined = "".join(codes)
        out.append((conv, part, seq, joined, "\x00".join(initials), list(uids), transfer(joined)))
        seq += 1
        for rows in (codes, initials, uids):
            rows.clear()

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        types[0] = batch.schema.field("conv_id").type
        for key, code, initial, uid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "code", "initial", "uid"))):
            if codes and key != conv:
                close()
                length = first_block
            elif len(codes) >= length:
                close()
                length += 1
            conv = key
            codes.append(code)
            initials.append(initial)
            uids.append(uid)
        if len(out) >= 4096:
            yield flush()
    if codes:
        close()
    if out:
        yield flush()


@F.pandas_udf(T.ArrayType(CHECKPOINT))
def _checkpoints(blocks: pd.Series) -> pd.Series:
    """State costs after each block of a conversation, backward; `seam` counts an unlawful pair with the block before."""
    def of(rows) -> list[tuple]:
        after, out = END, []
        for i in range(len(rows) - 1, -1, -1):
            r = rows[i]
            seam = int(i > 0 and not lawful(rows[i - 1]["to"] + r["from"]))
            least = min(after)
            out.append({"part": r["part"], "seq": r["seq"], "after": [c - least for c in after], "is_last": i == len(rows) - 1, "seam": seam})
            after = through(list(r["costs"]), after)
        return out[::-1]
    return blocks.map(of)


@F.pandas_udf(T.ArrayType(ENTRY))
def _entries(blocks: pd.Series) -> pd.Series:
    """The state in which each block of a conversation is entered."""
    def of(rows) -> list[tuple]:
        state, out = START, []
        for r in rows:
            out.append({"part": r["part"], "seq": r["seq"], "state": state})
            state = int(r["exits"][state])
        return out
    return blocks.map(of)


@F.pandas_udf(WALK)
def _walks(codes: pd.Series, initials: pd.Series, after: pd.Series, last: pd.Series, alone: pd.Series) -> pd.DataFrame:
    """Each block walked from all states, or from the first one only if it is a whole conversation."""
    out = []
    for code, names, end, is_last, whole in zip(codes, initials, after, last, alone):
        walked = [walk(code, END if whole else tuple(end), s, bool(whole or is_last)) for s in range(1 if whole else 4)]
        letters = names.split("\x00")
        pairs = sum(not lawful(a + b) for a, b in zip(letters, letters[1:]))
        out.append(([w[0] for w in walked], [w[1] for w in walked], [w[2] for w in walked], pairs))
    return pd.DataFrame(out, columns=["exits", "audits", "costs", "unlawful"])


@F.pandas_udf(T.ArrayType(EDIT))
def _edits(audits: pd.Series, states: pd.Series, codes: pd.Series, uids: pd.Series) -> pd.Series:
    def of(audit: str, state: int, code: str, ids) -> list[dict]:
        out, at = [], 0
        for step, edit in enumerate(audit):
            if edit == "K":
                state = kept_state(code[at], state)
            elif edit != "D":
                state = FOLLOWS[state]
            out.append({"step": step, "edit": edit, "uid": None if edit == "I" else int(ids[at]), "new_role": ROLE[state] if edit in "IR" else None})
            at += edit != "I"
        return out
    return pd.Series([of(*x) for x in zip(audits, states, codes, uids)])


@dataclass(frozen=True)
class Repair:
    """`blocks`: `(conv_id, part, seq, audit, cost, unlawful)`, in the order of part and seq.
    `edits`: `(conv_id, part, seq, step, edit, turn, role, text)`, one row for each edit in that order, with the turn as it leaves
    the edit (as it was, if deleted). `turns`: the turns with their faults."""

    turns: DataFrame
    blocks: DataFrame
    edits: DataFrame


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           first_block: int = FIRST_BLOCK) -> Repair:
    """The cheapest edits of every conversation, all tables stored.

    Turns go by number, nulls first, and by a digest of role and text where the number repeats. Null roles and texts count
    as one space; a null id is a conversation of its own. A role that doesn't begin with s, u or a, an empty one included, fits
    nowhere and must be changed or deleted. Empty texts are blank. Turns that repeat are copies of each other, of which the
    first stays. A table without rows gives none. Other columns are not read.
    """
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    stored = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")
    keyed = stored.withColumn("digest", F.unhex(F.sha2(F.concat(F.col("role"), F.lit(":"), F.col("text")), 256)))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest", "uid"]
    marked = materialize(faults(keyed).select("conv_id", "turn", "digest", "uid", "fault", edit_code(F.col("role"), F.col("fault")).alias("code"),
                                              F.substring("role", 1, 1).alias("initial")), "faults")
    lanes = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv = marked.schema["conv_id"]
    blocks = materialize(marked.repartitionByRange(lanes, *order).sortWithinPartitions(*order).select("conv_id", "code", "initial", "uid").mapInArrow(
        lambda batches: _cut(batches, first_block), T.StructType([conv, *BLOCK.fields])), "blocks")

    ends = F.struct("part", "seq", "costs", F.substring_index("initials", "\x00", 1).alias("from"), F.substring_index("initials", "\x00", -1).alias("to"))
    long = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(ends)).alias("rows")).filter(F.size("rows") > 1)
    checkpoints = long.select(F.explode(_checkpoints("rows")).alias("x")).select("x.*")
    walks = materialize(blocks.drop("costs").join(checkpoints, ["part", "seq"], "left").withColumn("alone", F.col("after").isNull()).withColumn(
        "walk", _walks("codes", "initials", "after", "is_last", "alone")).select(
        "conv_id", "part", "seq", "codes", "uids", "alone", "seam", "walk.*"), "walks")

    exits = walks.filter("not alone").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "exits"))).alias("rows"))
    entered = exits.select(F.explode(_entries("rows")).alias("x")).select("x.*")
    state = F.coalesce("state", F.lit(START))
    chosen = materialize(walks.join(entered, ["part", "seq"], "left").select(
        "conv_id", "part", "seq", "codes", "uids", state.alias("state"), F.get("audits", state).alias("audit"),
        F.get("costs", state).cast("long").alias("cost"), (F.col("unlawful") + F.coalesce("seam", F.lit(0))).cast("long").alias("unlawful")), "walked")
    steps = chosen.select("conv_id", "part", "seq", F.explode(_edits("audit", "state", "codes", "uids")).alias("e")).select("conv_id", "part", "seq", "e.*")
    edits = materialize(steps.join(stored.select("uid", "turn", "role", "text"), "uid", "left").select(
        "conv_id", "part", "seq", "step", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")), "edits")
    return Repair(marked, chosen.select("conv_id", "part", "seq", "audit", "cost", "unlawful"), edits)


def damaged(conversations: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text)` with the faults that the CRC-32 of each row's `conv_id:turn` tells to put in: 0 drops the row, 1
    empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's. A null is one space, in the key too."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(copies).alias("copy")).drop("copy")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the newline-joined lines of each run of a conversation, line by line."""
    conv, begun, state, kind = None, False, hashlib.sha256(), None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for key, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if begun and key == conv:
                state.update(b"\n")
            else:
                if begun:
                    out.append((conv, state.hexdigest()))
                conv, begun, state = key, True, hashlib.sha256()
            state.update(line.encode("utf-8", "surrogatepass"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out])], ["conv_id", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])


def digests(edits: DataFrame) -> DataFrame:
    """`(conv_id, repaired_sha256)` of each conversation of which a turn is left: the hash of its lines `role:text`.

    A hash has no parts, so one conversation's lines pass through one task, as a stream.
    """
    lines = edits.filter("edit <> 'D'").select("conv_id", "part", "seq", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    lanes = int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartition(lanes, "conv_id").sortWithinPartitions("conv_id", "part", "seq", "step").select("conv_id", "line")
    return ordered.mapInArrow(_hashes, T.StructType([edits.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def report(found: Repair, ids: DataFrame) -> DataFrame:
    """One row for each `conv_id` of `ids`: its faults, the cost and letters of its edits and the digest of what they leave."""
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    turns = found.turns.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
    blocks = found.blocks.groupBy("conv_id").agg(
        F.sum("unlawful").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda b: b["audit"]), "").alias("audit"))
    out = ids.select("conv_id").distinct()
    for side in (turns, blocks, digests(found.edits)):
        side = side.withColumnRenamed("conv_id", "c")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same forward, with the least (cost, edits) of every state kept for each turn.
SQL = r"""
with recursive fated as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key,
         xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1)))), lambda c, b:
           list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 as fate  -- CRC-32
  from conversations),
rows_ as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
         case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from fated cross join (values (0), (1)) as c(copy) where fate <> 0 and (copy = 0 or fate = 3)),
placed as (
  select *, row_number() over (partition by conv_id, role, text order by n) as again
  from (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(role || ':' || text)) as n from rows_)),
judged as (
  select conv_id, turn, role, text, n, case when not regexp_matches(text, '[^ \t\n\v\f\r]') then 'b' when again > 1 then 'd'
    when not regexp_matches(rtrim(text, e' \t\n\x0b\x0c\r'), '[.!?]$') then 't' else '' end as fault,
    lag(role) over (partition by conv_id order by n) as before from placed),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (before is not null and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal, max(n) as last
  from judged group by conv_id),
steps as (
  select conv_id, 0::bigint as n, {'c': 0, 'a': '', 't': ''} as st, {'c': 999999999, 'a': '', 't': ''} as sy,
         {'c': 3, 'a': 'I', 't': e'\nuser:'} as us, {'c': 6, 'a': 'II', 't': e'\nuser:\nassistant:'} as an from facts
  union all
  select conv_id, n, st, sy, least(us, {'c': an.c + 3, 'a': an.a || 'I', 't': an.t || e'\nuser:'}, {'c': st.c + 3, 'a': st.a || 'I', 't': st.t || e'\nuser:'},
                                   {'c': sy.c + 3, 'a': sy.a || 'I', 't': sy.t || e'\nuser:'}) as us,
         least(an, {'c': us.c + 3, 'a': us.a || 'I', 't': us.t || e'\nassistant:'}, {'c': st.c + 6, 'a': st.a || 'II', 't': st.t || e'\nuser:\nassistant:'},
                   {'c': sy.c + 6, 'a': sy.a || 'II', 't': sy.t || e'\nuser:\nassistant:'}) as an
  from (
    select s.conv_id, j.n, {'c': st.c + 4, 'a': st.a || 'D', 't': st.t} as st,
      least({'c': sy.c + 4, 'a': sy.a || 'D', 't': sy.t},
            {'c': case when fault not in ('b', 'd') and left(role, 1) = 's' then st.c + x else 999999999 end, 'a': st.a || 'K', 't': st.t || e'\n' || role || ':' || text}) as sy,
      list_min(list_concat([{'c': us.c + 4, 'a': us.a || 'D', 't': us.t}], list_transform([st, sy, an], lambda f: {
        'c': case when fault in ('b', 'd') then 999999999 when left(role, 1) = 'u' then f.c + x else f.c + x + 3 end,
        'a': f.a || case when left(role, 1) = 'u' then 'K' else 'R' end,
        't': f.t || e'\n' || case when left(role, 1) = 'u' then role else 'user' end || ':' || text}))) as us,
      least({'c': an.c + 4, 'a': an.a || 'D', 't': an.t}, {
        'c': case when fault in ('b', 'd') then 999999999 when left(role, 1) = 'a' then us.c + x else us.c + x + 3 end,
        'a': us.a || case when left(role, 1) = 'a' then 'K' else 'R' end,
        't': us.t || e'\n' || case when left(role, 1) = 'a' then role else 'assistant' end || ':' || text}) as an
    from steps s join (select *, case fault when 't' then 3 else 0 end as x from judged) j
      on j.conv_id is not distinct from s.conv_id and j.n = s.n + 1)),
best as (select s.conv_id, least(st, an) as b from steps s join facts f on f.conv_id is not distinct from s.conv_id and f.last = s.n)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost,
       coalesce(b.a, '') as audit, sha256(coalesce(b.t[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join facts f on f.conv_id is not distinct from i.conv_id
left join best on best.conv_id is not distinct from i.conv_id
"""


@query("op11_checkpointed_turn_repair", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, the cheapest edits that mend it, and a digest of the result."""
    conversations = table(spark, sf_dir, "conversations")
    return report(repair(damaged(conversations)), conversations)
