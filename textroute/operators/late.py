"""One row per key of a wide table: narrow columns are ranked, the rows that lose are left out where they lie."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

ROW = "_row"
HEX = "0123456789abcdef"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def located(stored: DataFrame) -> DataFrame:
    """Add a locator to a Parquet table as it was read: file and place in the file. Nothing is written.

    Apply it to the scan itself, before joins, unions or explodes.
    """
    return stored.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(ROW))


def numbered(df: DataFrame, name: str = "numbered") -> DataFrame:
    """Store any frame with a number per row as locator; numbers are unique, not consecutive."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def _digest(columns: list[Column]) -> Column:
    """128 bits of the columns; nulls count."""
    options = {"ignoreNullFields": "false", "timestampFormat": MICROS, "timestampNTZFormat": MICROS}
    return F.md5(F.to_json(F.struct(*columns), options)) if columns else F.lit("")


def narrow_rows(rows: DataFrame, key: Column, order: list[Column], wide: list[Column]) -> DataFrame:
    """`(_key, _order, _digest, _row)`: all that ranking needs. `wide` columns are there as a digest only."""
    return rows.select(key.alias("_key"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_order"),
                       _digest(wide).alias("_digest"), ROW)


def repeated_keys(narrow: DataFrame) -> DataFrame:
    """`(_key, _order, _first, _contested)` of the keys with several rows; sums are combined in the map tasks.

    `_first` is the locator of the earliest row. A key is contested if its earliest rows differ in a wide column: the
    smallest and the largest digest among them, the latter as the smallest with its digits flipped, aren't the same.
    """
    flipped = F.translate("_digest", HEX, HEX[::-1]).alias("_flipped")
    low, high = F.min(F.struct("_order", "_digest", ROW)), F.min(F.struct("_order", flipped))
    return (narrow.groupBy("_key").agg(F.count("*").alias("_n"), low.alias("_low"), high.alias("_high"))
                  .filter("_n > 1")
                  .select("_key", F.col("_low._order").alias("_order"), F.col(f"_low.{ROW}").alias("_first"),
                          (F.col("_low._digest") != F.translate("_high._flipped", HEX[::-1], HEX)).alias("_contested")))


def _on(left: DataFrame, right: DataFrame, *names: str) -> list[Column]:
    """Equality that also holds between nulls: rows without a key are one group."""
    return [left[n].eqNullSafe(right[n]) for n in names]


def contested_rows(narrow: DataFrame, repeated: DataFrame) -> DataFrame:
    """`(_key, _row)`: one row per distinct content among the earliest rows of contested keys."""
    asked = broadcast_if_small(repeated.filter("_contested").select("_key", "_order"))
    rows = narrow.join(asked, _on(narrow, asked, "_key", "_order"), "left_semi")
    return rows.groupBy("_key", "_digest").agg(F.min(ROW).alias(ROW)).select("_key", ROW)


def losing_rows(rows: DataFrame, key: Column, order: list[Column], wide: list[Column]) -> DataFrame:
    """`_row` of every row that isn't the first of its key by `order`, then `wide`, nulls first."""
    narrow = materialize(narrow_rows(rows, key, order, wide), "narrow")
    repeated = materialize(repeated_keys(narrow), "repeated")
    candidates = broadcast_if_small(materialize(contested_rows(narrow, repeated), "contested"))
    texts = rows.withColumns({f"_w{i}": c for i, c in enumerate(wide)}).join(candidates, ROW)
    best = F.min(F.struct(*[f"_w{i}" for i in range(len(wide))], ROW))
    settled = texts.groupBy("_key").agg(best.alias("_best")).select("_key", F.col(f"_best.{ROW}").alias("_settled"))
    winners = (repeated.join(settled, _on(repeated, settled, "_key"), "left")
                       .select(repeated["_key"], F.coalesce("_settled", "_first").alias("_winner")))
    winners = broadcast_if_small(materialize(winners, "winners"))
    paired = narrow.join(winners, _on(narrow, winners, "_key"))
    return materialize(paired.filter(F.col(ROW) != F.col("_winner")).select(ROW), "losers")


def first_rows(rows: DataFrame, key: Column, order: list[Column], wide: list[Column] = ()) -> DataFrame:
    """`rows`, which hold a locator, with the first row of every key; ties beyond all columns by locator.

    Wide columns cross the network only for rows that tie in key and `order` and differ in a wide column. The losing
    rows are measured: if their locators fit they are broadcast and the table is filtered where it lies, else the
    anti join shuffles by locator, which has no hot values.
    """
    losers = broadcast_if_small(losing_rows(rows, key, list(order), list(wide)))
    return rows.join(losers, ROW, "left_anti").select([c for c in rows.columns if c != ROW])


def dedupe_ids(rows: DataFrame, key: str = "complaint_id", first: str = "date_received") -> DataFrame:
    """`cleaning.dedupe_ids` for a table with a locator: the earliest row per id, ties by text, then the other columns."""
    others = ["narrative", *[c for c in rows.columns if c not in (key, first, "narrative", ROW)]]
    return first_rows(rows, F.col(key), [F.col(first)], [F.col(c) for c in others])


def dedupe_train(rows: DataFrame) -> DataFrame:
    """`splitting.dedupe_train` for a table with a locator: the earliest train row of every text."""
    train = first_rows(rows.filter("split = 'train'"), F.sha2("narrative", 256),
                       [F.col("date_received"), F.col("complaint_id")])
    return train.unionByName(rows.filter("split <> 'train'").drop(ROW))
