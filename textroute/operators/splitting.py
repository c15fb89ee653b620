"""Split by time with a guard against texts that occur on both sides."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import order_statistics
from ..session import broadcast_if_small, materialize


@dataclass(frozen=True)
class Cut:
    """The first row, by date and id, of the later side; None when that side is empty."""
    date: object
    id: int


def cut_points(df: DataFrame, val_frac: float = 0.10, test_frac: float = 0.10) -> tuple[Cut | None, Cut | None]:
    """Where validation and test begin when the rows are ordered by date, then id.

    The table is not sorted. Per-date counts (one row per calendar day) locate the day of each
    cut; the id within the day comes from counting slices of that day's id range, so a day that
    holds a third of all rows is still spread over all tasks.
    """
    per_date = df.groupBy("date_received").agg(F.count("*").alias("n"))
    # One row per calendar day: the running sum is over a few thousand rows.
    running = Window.orderBy("date_received").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = per_date.withColumn("upto", F.sum("n").over(running))
    total = per_date.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # Truncated products in this order of subtraction; the positions depend on it.
    starts = [int(total * (1 - test_frac - val_frac)), int(total * (1 - test_frac))]
    cuts: list[Cut | None] = []
    for start in starts:
        day = days.filter(F.col("upto") > start).orderBy("date_received").limit(1).collect()
        if not day:
            cuts.append(None)
            continue
        date, offset = day[0]["date_received"], start - (day[0]["upto"] - day[0]["n"])
        that_day = df.filter(F.col("date_received") == F.lit(date))
        cuts.append(Cut(date, order_statistics(that_day, "complaint_id", [offset])[offset]))
    return cuts[0], cuts[1]


def _at_or_after(cut: Cut | None) -> Column:
    if cut is None:
        return F.lit(False)
    date = F.lit(cut.date)
    return (F.col("date_received") > date) | (
        (F.col("date_received") == date) & (F.col("complaint_id") >= F.lit(cut.id)))


def temporal_split(df: DataFrame, val_frac: float = 0.10, test_frac: float = 0.10) -> DataFrame:
    """Add `split`: the most recent rows are `test`, those before them `val`, the rest `train`.

    Once the two cuts are known this is a projection: no exchange.
    """
    val, test = cut_points(df, val_frac, test_frac)
    return df.withColumn("split", F.when(_at_or_after(test), "test")
                                   .when(_at_or_after(val), "val").otherwise("train"))


def _digest(text: str = "narrative") -> Column:
    return F.sha2(F.col(text), 256)


def dedupe_train(df: DataFrame) -> DataFrame:
    """Keep the earliest train row of every text; the other splits are untouched.

    The rank is cut to one row per text in the map tasks, before the exchange.
    """
    rank = Window.partitionBy("_digest").orderBy("date_received", "complaint_id")
    train = (df.filter("split = 'train'").withColumn("_digest", _digest())
               .withColumn("_rank", F.row_number().over(rank))
               .filter("_rank = 1").drop("_rank", "_digest"))
    return train.unionByName(df.filter("split <> 'train'"))


def leaked_digests(df: DataFrame) -> DataFrame:
    """Digests of texts that occur in train and again in a later split.

    Both sides are reduced to distinct digests before they meet, so repeated texts do not skew.
    """
    later = df.filter("split <> 'train'").select(_digest().alias("_digest")).distinct()
    train = df.filter("split = 'train'").select(_digest().alias("_digest")).distinct()
    return later.join(train, "_digest", "left_semi")


def leakage_guard(df: DataFrame, leaked: DataFrame | None = None) -> DataFrame:
    """Drop later rows whose text occurs in train; train rows are untouched.

    The leaked digests are stored and measured: if they fit they are broadcast and the rows stay
    where they are, else the anti join shuffles and adaptive execution splits hot texts.
    """
    if leaked is None:
        leaked = materialize(leaked_digests(df), "leaked")
    later = (df.filter("split <> 'train'").withColumn("_digest", _digest())
               .join(broadcast_if_small(leaked), "_digest", "left_anti").drop("_digest"))
    return df.filter("split = 'train'").unionByName(later.select(df.columns))


def train_class_counts(df: DataFrame, label: str = "product") -> DataFrame:
    """Rows per class among the distinct train texts, each counted for its earliest row's class."""
    first = F.min_by(label, F.struct("date_received", "complaint_id")).alias(label)
    texts = df.filter("split = 'train'").groupBy(_digest().alias("_digest")).agg(first)
    return texts.groupBy(label).agg(F.count("*").alias("n"))


def drop_rare_classes(df: DataFrame, counts: DataFrame, min_count: int = 50, label: str = "product") -> DataFrame:
    """Keep rows, in every split, of classes with at least `min_count` rows in `counts`."""
    kept = counts.filter(F.col("n") >= min_count).select(label)
    return df.join(broadcast_if_small(kept), label, "left_semi").select(df.columns)


def guarded_split(df: DataFrame, val_frac: float = 0.10, test_frac: float = 0.10,
                  min_class_count: int = 50) -> DataFrame:
    """The whole preparation: split, one row per train text, no leakage, no rare classes.

    Pass a stored table: the cuts, the leaked digests and the class counts are computed first.
    """
    split = temporal_split(df, val_frac, test_frac)
    counts = materialize(train_class_counts(split), "class-counts")
    guarded = leakage_guard(dedupe_train(split), materialize(leaked_digests(split), "leaked"))
    return drop_rare_classes(guarded, counts, min_class_count)


def split_meta(df: DataFrame, val_frac: float = 0.10, test_frac: float = 0.10,
               min_class_count: int = 50) -> DataFrame:
    """One row that describes the guarded split of `df`, counted without moving the texts."""
    split = temporal_split(df, val_frac, test_frac)
    counts = materialize(train_class_counts(split), "class-counts")
    leaked = materialize(leaked_digests(split), "leaked")
    kept = counts.filter(F.col("n") >= min_class_count)
    guarded = leakage_guard(dedupe_train(split), leaked)
    rows = drop_rare_classes(guarded, counts, min_class_count)
    per_split = rows.groupBy("split").agg(
        F.count("*").alias("n"), F.min("date_received").cast("string").alias("a"),
        F.max("date_received").cast("string").alias("b"), F.collect_set("product").alias("classes"))

    def pick(name: str, value: str) -> Column:
        return F.max(F.when(F.col("split") == name, F.col(value)))

    seen = split.filter("split <> 'train'").withColumn("_digest", _digest())
    lost = seen.join(broadcast_if_small(leaked), "_digest", "left_semi").agg(
        F.struct(F.count_if(F.col("split") == "val").alias("val"),
                 F.count_if(F.col("split") == "test").alias("test"))).scalar()
    names = kept.agg(F.sort_array(F.collect_set("product"))).scalar()
    all_names = df.agg(F.collect_set("product")).scalar()
    return (per_split.agg(
                *[F.coalesce(pick(s, "n"), F.lit(0)).alias(f"n_{s}") for s in ("train", "val", "test")],
                *[F.array(pick(s, "a"), pick(s, "b")).alias(f"{s}_dates") for s in ("train", "val", "test")],
                pick("train", "classes").alias("_train"), pick("test", "classes").alias("_test"))
            .withColumn("classes", names)
            .withColumn("dropped_classes", F.sort_array(F.array_except(all_names, "classes")))
            .withColumn("unseen_in_test", F.sort_array(F.array_except(
                F.coalesce("_test", F.array().cast("array<string>")), F.coalesce("_train", F.array().cast("array<string>")))))
            .withColumn("_lost", lost)
            .withColumn("leaked_removed_val", F.col("_lost.val"))
            .withColumn("leaked_removed_test", F.col("_lost.test"))
            .drop("_train", "_test", "_lost"))
