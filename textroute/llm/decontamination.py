"""Benchmark decontamination: passages of documents that repeat a benchmark item.

Per item, documents are looked at through all windows of the item's number of words.

1. The documents' shingle hashes are joined with those of the benchmark. Similarity `t` of bags of `a` and `b` shingles
   needs `t * (a + b) / (1 + t)` shared ones, so a window needs as many hits. The starts of all windows that have them
   follow from the sorted hits, in whatever order the window repeats the item. Hits are kept in spans of four windows,
   so that no row grows with the document.
2. These windows get SimHash fingerprints. The distinct ones of an item are looked up in a multi-index of Hamming
   blocks, which finds all fingerprints within the radius that the similarity needs.
3. The exact similarity of the shingles, weighted by how often they occur, decides in each window found.

A window is lost if its fingerprint lies beyond the radius: below one in a million at the very threshold of 0.8.

Everything is DataFrame code: hashes, starts, fingerprints and similarities are column expressions.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textroute.llm import window_fingerprints as wf
from textroute.llm.registry import fresh, query, table
from textroute.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
SPAN = 4  # windows whose starts share a row


def words(text: Column) -> Column:
    """Letters and digits in lower case, cut at everything else; no words for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashes: Column, k: Column | int) -> Column:
    """Hashes of all runs of `k` words, given the words' hashes; none for fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    starts = F.when(F.size(hashes) >= k, F.sequence(F.lit(1), F.size(hashes) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, k)))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def similarity(a: Column, b: Column) -> Column:
    """Weighted similarity of two bags, by one pass over both in sorted order."""
    tagged = F.sort_array(F.concat(F.transform(a, lambda h: F.struct(h.alias("h"), F.lit(0).alias("side"))),
                                   F.transform(b, lambda h: F.struct(h.alias("h"), F.lit(1).alias("side")))))
    zero = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        same = s["h"].eqNullSafe(x["h"])
        return F.struct(x["h"].alias("h"), (F.when(same, s["a"]).otherwise(0) + 1 - x["side"]).alias("a"),
                        (F.when(same, s["b"]).otherwise(0) + x["side"]).alias("b"),
                        (s["sum"] + F.when(same, 0).otherwise(F.least(s["a"], s["b"]))).alias("sum"))

    def share(s: Column) -> Column:
        shared = s["sum"] + F.least(s["a"], s["b"])
        return shared / (F.size(a) + F.size(b) - shared)
    return F.aggregate(tagged, zero, step, share)


def window_starts(at: Column, need: Column, width: Column, low: Column, high: Column) -> Column:
    """The starts from `low` to `high` of windows of `width` shingles that have `need` of the sorted places `at`.

    Each start belongs to the window's first place, so none is made twice.
    """
    firsts = F.when(F.size(at) >= need, F.sequence(F.lit(1), F.size(at) - need + 1)).otherwise(F.array().cast("array<int>"))

    def of_first(i: Column) -> Column:
        first = F.greatest(low, F.when(i > 1, F.get(at, i - 2) + 1).otherwise(low), F.get(at, i + need - 2) - width + 1)
        last = F.least(F.get(at, i - 1), high)
        return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(firsts, of_first))


def same_text(of_doc: str, of_text: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.col("text_hash") == F.col(of_text))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """`(doc_id, item_id, similarity, start, text_hash)`: documents with a passage at least `threshold` similar to an item.

    One row for each document (id and text) and item, with the best window of all: `start` is its first word,
    counted from 0; the earliest counts among equals. Items shorter than five words are one shingle; items without a word, or null,
    match nothing, and so do wordless or null documents. A document with fewer words than the item is one window.
    Repeated rows of a document count once, and texts that share an id are judged apart. Null ids are ids like
    any other. Other columns are not read.
    """
    bits = wf.radius(threshold)
    blocks = wf.block_count(bits)
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), word_hashes(words(F.col(f"`{item_text}`"))).alias("w")).distinct()
    items = items.filter(F.size("w") > 0).select(
        F.xxhash64("item_id", "w").alias("item_row"), "item_id", F.size("w").alias("n"),
        F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    items = items.select("item_row", "item_id", "n", "k", F.sort_array(shingles(F.col("w"), F.col("k"))).alias("bag"))
    items = materialize(items.withColumn("item_code", wf.fingerprint(F.col("bag"))), "items")
    grams = materialize(items.select("item_row", "n", "k", F.explode("bag").alias("h")).distinct(), "item-shingles")
    lengths = [r.k for r in grams.select("k").distinct().collect()] or [SHINGLE]  # 1 to 5

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
                       F.col(f"`{text}`").alias("text"))
    hashed = rows.select("doc_id", "text_hash", word_hashes(words(F.col("text"))).alias("w"))
    runs = reduce(DataFrame.unionByName, [
        hashed.select("doc_id", "text_hash", F.size("w").alias("words"), F.lit(k).alias("k"),
                      F.posexplode(shingles(F.col("w"), k)).alias("pos", "h")) for k in sorted(lengths)])
    # A hit belongs to the span of starts it is in, and to the one before if windows of that one reach it.
    width, span = F.least("n", "words") - F.col("k") + 1, F.lit(SPAN) * F.col("width")
    hits = runs.join(grams, ["k", "h"]).withColumn("width", width).withColumn("base", F.col("pos") - F.col("pos") % span)
    reached = (F.col("base") > 0) & (F.col("pos") - F.col("base") < F.col("width") - 1)
    hits = (hits.withColumn("base", F.explode(F.when(reached, F.array("base", F.col("base") - span)).otherwise(F.array("base"))))
            .groupBy("doc_id", "text_hash", "words", "item_row", "n", "k", "width", "base").agg(F.collect_set("pos").alias("at")))
    size = F.col("n") - F.col("k") + 1
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * (size + F.col("width")) / F.lit(1 + threshold) - F.lit(1e-9)).cast("int"))
    last = F.least(F.greatest(F.lit(0), F.col("words") - F.col("n")), F.col("base") + span - 1)
    starts = hits.withColumn("need", need).filter(F.size("at") >= F.col("need")).select(
        F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "item_row", "k", "width", "base",
        window_starts(F.sort_array("at"), F.col("need"), F.col("width"), F.col("base"), last).alias("starts"))
    starts = materialize(starts.filter(F.size("starts") > 0), "window-starts")

    # Only texts with such windows are cut into words again; the spans of one text are spread over tasks.
    texts = rows.join(starts.select("of_doc", "of_text").distinct(), same_text("of_doc", "of_text"), "left_semi").select(
        "doc_id", "text_hash", word_hashes(words(F.col("text"))).alias("w"))
    part = F.slice("w", F.col("base") + 1, span + F.col("width") + F.col("k") - 2)
    parts = (texts.join(starts, same_text("of_doc", "of_text"))
             .select("doc_id", "text_hash", "item_row", "k", "width", "base", "starts", part.alias("w"))
             .repartition("doc_id", "text_hash", "item_row", "base")
             .withColumn("runs", shingles(F.col("w"), F.col("k"))))

    def window(start: Column) -> Column:
        return F.sort_array(F.slice("runs", start - F.col("base") + 1, F.col("width")))
    codes = F.transform("starts", lambda s: F.struct(s.alias("start"), wf.fingerprint(window(s)).alias("code")))
    parts = materialize(parts.select("doc_id", "text_hash", "item_row", "width", "base", "runs", codes.alias("codes")), "windows")

    index = items.select("item_row", "item_code", F.inline(wf.indexed(F.col("item_code"), blocks)))
    near = (parts.select("item_row", F.explode("codes.code").alias("code")).distinct()
            .select("item_row", "code", F.inline(wf.looked_up(F.col("code"), blocks)))
            .join(index, ["item_row", "block", "value"])
            .filter((wf.distance(F.col("code"), F.col("item_code")) <= bits)
                    & (F.col("block") == wf.first_block(F.col("code"), F.col("item_code"), blocks))).select("item_row", "code"))
    bags = items.select("item_row", "item_id", "bag")
    scored = (parts.select("doc_id", "text_hash", "item_row", "width", "base", "runs", F.inline("codes"))
              .select("doc_id", "text_hash", "item_row", F.col("start").cast("long").alias("start"), "code",
                      window(F.col("start")).alias("window"))
              .join(near, ["item_row", "code"]).join(bags, "item_row")
              .select("doc_id", "text_hash", "item_id", "start", similarity(F.col("window"), F.col("bag")).alias("similarity")))
    best = (scored.groupBy("doc_id", "text_hash", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
            .filter(F.col("best.similarity") >= threshold))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), "text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` in which no benchmark item was found, with all their columns."""
    key, code = fresh(docs, "found_id"), fresh(docs, "found_hash")
    found = materialize(contaminated(docs, benchmark, doc_id, text).select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(code)).distinct(), "contaminated")
    return docs.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(code)), "left_anti")


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items they repeat, with the best window."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
