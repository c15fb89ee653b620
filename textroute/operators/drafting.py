"""Prompts for a text generator, its replies, and the report on each draft."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guardrails import check_citations, redacted
from .retrieval import Index, search

# The wording of a prompt.
NO_EXCERPTS = "(no policy excerpts available)"
PROMPT_HEAD = "Predicted product category: "
PROMPT_CASE = "\nCase reference: "
PROMPT_EXCERPTS = "\n\nPOLICY EXCERPTS:\n"
PROMPT_RECORD = "\n\nCONSUMER COMPLAINT:\n"
PROMPT_END = "\n\nWrite the first response now."

CHUNKS_TYPE = "array<struct<id:string,title:string,text:string>>"


def case_ref(c: Column) -> Column:
    return F.format_string("NB-%06d", c)


def retrieved_chunks(records: DataFrame, index: Index, k: int = 4) -> DataFrame:
    """`(complaint_id, chunks)`: each record's best chunks in rank order, at most `k`."""
    queries = records.select(F.col("complaint_id").alias("query_id"), F.col("product"),
                             redacted(F.col("narrative")).alias("text"))
    hits = search(queries, index, k).select("query_id", "rank", "id")
    texts = index.chunks.select("id", "title", "text")
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "title", "text")))
    return (hits.join(texts, "id").groupBy(F.col("query_id").alias("complaint_id")).agg(items.alias("c"))
                .select("complaint_id", F.transform("c", lambda x: F.struct(
                    x["id"].alias("id"), x["title"].alias("title"), x["text"].alias("text"))).alias("chunks")))


def prompt_text(product: Column, ref: Column, chunks: Column, narrative: Column) -> Column:
    numbered = F.transform(chunks, lambda c, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] ("), c["title"], F.lit(") "), c["text"]))
    excerpts = F.when(F.size(chunks) > 0, F.array_join(numbered, "\n\n")).otherwise(NO_EXCERPTS)
    return F.concat(F.lit(PROMPT_HEAD), product, F.lit(PROMPT_CASE), ref, F.lit(PROMPT_EXCERPTS), excerpts,
                    F.lit(PROMPT_RECORD), narrative, F.lit(PROMPT_END))


def build_prompts(records: DataFrame, index: Index | None, k: int = 4) -> DataFrame:
    """`(complaint_id, case_ref, chunks, prompt)`; without an index the excerpts say there are none.

    `records` holds complaint_id, product (as predicted) and narrative.
    """
    none = F.array().cast(CHUNKS_TYPE)
    if index is None:
        rows = records.withColumn("chunks", none)
    else:
        rows = (records.join(retrieved_chunks(records, index, k), "complaint_id", "left")
                       .withColumn("chunks", F.coalesce("chunks", none)))
    rows = rows.withColumn("case_ref", case_ref(F.col("complaint_id")))
    prompt = prompt_text(F.col("product"), F.col("case_ref"), F.col("chunks"), redacted(F.col("narrative")))
    return rows.select("complaint_id", "case_ref", "chunks", prompt.alias("prompt"))


Generator = Callable[[pd.Series], pd.DataFrame]


def generate_batch(prompts: DataFrame, make_generator: Callable[[], Generator]) -> DataFrame:
    """Run a caller's text generator over `(complaint_id, prompt)` in Arrow batches.

    `make_generator` is called once per task (open clients there); its result maps a batch of
    prompts to columns draft, input_tokens and output_tokens. `latency_s` is the mean over the batch.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make_generator()
        for batch in batches:
            if batch.empty:
                continue
            start = time.perf_counter()
            out = generator(batch["prompt"])
            out = out[["draft", "input_tokens", "output_tokens"]].reset_index(drop=True)
            out.insert(0, "complaint_id", batch["complaint_id"].to_numpy())
            out["latency_s"] = (time.perf_counter() - start) / len(batch)
            yield out

    schema = "complaint_id long, draft string, input_tokens long, output_tokens long, latency_s double"
    return prompts.select("complaint_id", "prompt").mapInPandas(run, schema)


def template_generator() -> Generator:
    """A deterministic generator for tests and dry runs: a fixed sentence, tokens = words."""
    def run(prompts: pd.Series) -> pd.DataFrame:
        drafts = prompts.map(lambda p: "Dear Customer, we will investigate within 10 business days [1]."
                             if NO_EXCERPTS not in p else "Dear Customer, we will follow up.")
        return pd.DataFrame({"draft": drafts, "input_tokens": prompts.str.split().str.len(),
                             "output_tokens": drafts.str.split().str.len()})
    return run


def cost_usd(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Add `cost_usd` from token counts and `(model, input_per_m, output_per_m)`; unknown models cost 0.

    The price list has one row per model, so it is broadcast.
    """
    listed = F.broadcast(prices.select("model", "input_per_m", "output_per_m"))
    cost = (F.col("input_tokens") * F.coalesce("input_per_m", F.lit(0.0))
            + F.col("output_tokens") * F.coalesce("output_per_m", F.lit(0.0))) / 1e6
    return df.join(listed, "model", "left").withColumn("cost_usd", cost).drop("input_per_m", "output_per_m")


def draft_report(drafts: DataFrame) -> DataFrame:
    """Add the citation report of each draft against its own chunks."""
    return (check_citations(drafts.withColumn("_texts", F.col("chunks.text")), "draft", "_texts")
            .drop("_texts"))


def flag_for_review(df: DataFrame) -> DataFrame:
    """A person must look when the routing is unsure or the citation check fails."""
    return df.withColumn("flag_for_review", F.col("needs_review") | ~F.col("citations.ok"))
