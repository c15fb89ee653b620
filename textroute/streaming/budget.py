"""The daily budget as keyed state: what has been spent is kept per UTC day and forgotten with the day.

A busy day doesn't meet in one task. Its requests are dealt to shards, and each shard keeps what it let through so far. Of
its own requests, those before which the shard alone has spent the cap are rejected at once: whatever the other shards do,
the day had spent as much. What is left, a few per shard since the cap bounds it, meets in one group per day, which decides.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import utc_instant

#: Money counts in whole units of 1e-12 dollars, as the batch operator's decimals do.
UNITS = 10**12
DAY_MS = 86_400_000
#: Shard of the requests that no shard could reject.
OPEN = -1


class Budget(StatefulProcessor):
    """Tells the requests of a key before which less than the cap was spent, in time order within a micro-batch.

    `sift` only sets the others apart, for a group that sees the rest of the day. Only requests under the cap are held
    in memory: any other is passed on as soon as it is known.
    """

    def __init__(self, cap_units: int, sift: bool) -> None:
        self.cap, self.sift = cap_units, sift

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "units string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, lane = key
        if not self.sift and lane != OPEN:
            for batch in rows:
                yield self._marked(batch, False)
            return
        known = self.spent.exists()
        spent, held = int(self.spent.get()[0]) if known else 0, None
        for batch in rows:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = held.sort_values(["budget_micros", "budget_tie"], kind="stable", ignore_index=True)
            before, under = spent, []
            for cost in held["budget_cost"]:
                under.append(before < self.cap)
                before += int(cost)
            if not all(under):
                mask = pd.Series(under)
                yield self._marked(held[~mask], False)
                held = held[mask].reset_index(drop=True)
        if held is not None and len(held):
            spent += sum(int(c) for c in held["budget_cost"])
            yield self._marked(held, True)
        self.spent.update((str(spent),))
        if not known:
            self.handle.registerTimer((pd.Timestamp(day).toordinal() - 719_163 + 1) * DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent.clear()
        yield from ()

    def close(self) -> None:
        pass

    def _marked(self, batch: pd.DataFrame, under: bool) -> pd.DataFrame:
        if self.sift:
            return batch.assign(budget_lane=OPEN if under else batch["budget_lane"])
        return batch.assign(admitted=under)


def admissions(log: DataFrame, cap: float, tie: str = "event_id", lateness: str = "7 days", shards: int = 16) -> DataFrame:
    """Draft requests of a stream with their `day` and whether they are `admitted`: less than `cap` was spent that UTC day.

    A day's state goes once the newest request is `lateness` past its end. A request that arrives later than that finds its
    day closed and is dropped.
    """
    cap_units, names = round(cap * UNITS), log.columns  # the processor sees columns by name, but not those that begin with _
    # A cost beyond the cap closes the day like one of the cap.
    cost = F.least(F.coalesce(F.col("draft_cost_usd"), F.lit(0.0)), F.lit(float(cap) + 1)).cast("decimal(28,12)")
    rows = (log.filter("endpoint = 'draft'").withColumn("day", F.to_date("ts")).withColumn("budget_at", utc_instant(F.col("ts")))
               .withColumn("budget_micros", F.unix_micros("budget_at")).withColumn("budget_tie", F.col(tie)).withColumn("budget_cost", (cost * UNITS).cast("decimal(38,0)").cast("string"))
               .withColumn("budget_lane", F.pmod(F.xxhash64(tie), F.lit(shards)).cast("int")).withWatermark("budget_at", lateness))
    sifted = rows.groupBy("day", "budget_lane").transformWithStateInPandas(
        Budget(cap_units, sift=True), rows.schema, "Append", "EventTime", eventTimeColumnName="budget_at")
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])
    decided = sifted.groupBy("day", "budget_lane").transformWithStateInPandas(Budget(cap_units, sift=False), schema, "Append", "EventTime")
    return decided.select(*names, "day", "admitted")
