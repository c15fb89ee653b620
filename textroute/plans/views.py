"""The supplied tables in the shape of the engine's inputs.

Each view is one SQL text that Spark and the checking database both run, so both sides start from
the same rows. Every view covers its whole table.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["documents", "labels", "events", "benchmark", "conversations", "embeddings"]

CLASSES = ["de", "en", "es", "fr"]

VIEWS = {
    # 13 clean columns; some texts are shorter than the contract allows.
    "complaints": """
        select doc_id as complaint_id, date '2018-01-01' + cast(doc_id % 2500 as int) as date_received,
               lang as product, cast(null as string) as sub_product, 'Issue' as issue,
               cast(null as string) as sub_issue, text as narrative, source as company, 'MD' as state,
               'ch' || cast(doc_id % 3 as string) as submitted_via, 'Closed' as company_response,
               case when doc_id % 7 = 0 then null else 'Yes' end as timely_response,
               cast(length(text) as int) as narrative_len
        from documents""",
    # The 18 columns of an export as text, with bad dates, missing cells, stray space and old labels.
    "raw_export": """
        select case when doc_id % 97 = 0 then 'not a date'
                    else cast(date '2018-01-01' + cast(doc_id % 2500 as int) as string) end as date_received,
               case lang when 'en' then 'Credit reporting' when 'fr' then ' Mortgage ' when 'de' then 'Money transfers'
                    else 'Student loan' end as product,
               'Part of ' || lang as sub_product, 'Issue' || chr(9) as issue, cast(null as string) as sub_issue,
               case when doc_id % 89 = 0 then 'N/A' when doc_id % 11 = 0 then chr(160) || ' ' || text || chr(10)
                    else text end as narrative,
               cast(null as string) as public_response,
               case when doc_id % 53 = 0 then 'None' else source end as company,
               chr(160) || 'MD' as state, '97' || cast(100 + doc_id % 900 as string) as zip, cast(null as string) as tags,
               'Agreed' as consent, 'Web' as submitted_via,
               cast(date '2018-01-01' + cast(doc_id % 2500 as int) as string) as date_sent,
               'In progress' as company_response, 'Yes' as timely_response,
               cast(null as string) as disputed, cast(case when doc_id % 10 = 1 then doc_id - 1 else doc_id end as string) as complaint_id
        from documents""",
    # One probability column per class, not yet scaled to 1.
    "proba_wide": """
        select doc_id as complaint_id,
               cast(1 + (doc_id * 7) % 17 + case when lang = 'de' then doc_id % 23 else 0 end as double) as de,
               cast(1 + (doc_id * 5) % 13 + case when lang = 'en' then doc_id % 29 else 0 end as double) as en,
               cast(1 + (doc_id * 3) % 11 + case when lang = 'es' then doc_id % 31 else 0 end as double) as es,
               cast(1 + (doc_id * 11) % 19 + case when lang = 'fr' then doc_id % 37 else 0 end as double) as fr
        from documents""",
    # Pages with a header (most), headings and blank-line paragraphs.
    "pages_raw": """
        select 'page_' || cast(doc_id as string) || '.md' as source,
               case when doc_id % 10 = 3 then '' else
                 '---' || chr(10) || 'title: ' || source || ': notes' || chr(10) || 'products: '
                 || case when doc_id % 5 = 0 then 'all' else lang || ' | x' || cast(doc_id % 4 as string) end
                 || chr(10) || '---' || chr(10) end
               || '# Heading' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || ' ' || chr(10)) as raw
        from documents""",
    "chunk_rows": """
        select 'benchmark#' || cast(item_id as string) as id, 'benchmark' as source,
               'Item ' || cast(item_id as string) as title,
               case item_id % 5 when 0 then 'de' when 1 then 'en' when 2 then 'es|en' when 3 then 'fr' else 'all' end
                 as product_list,
               text || ' We reply within ' || cast(item_id % 7 + 3 as string) || ' business days.' as text,
               cast(item_id as int) as position
        from benchmark""",
    "queries": """
        select conv_id * 1000 + turn as query_id, text,
               case conv_id % 6 when 0 then 'de' when 1 then 'en' when 2 then 'es' when 3 then 'fr'
                    when 4 then 'unlisted' else null end as product
        from conversations where role = 'user'""",
    "draft_rows": """
        select doc_id as complaint_id, case when doc_id % 2 = 0 then 'rag' else 'no_rag' end as condition,
               lang as true_product, case when doc_id % 3 = 0 then 'en' else lang end as pred_product,
               text as narrative,
               text || ' We will reply within ' || cast(doc_id % 9 + 2 as string) || ' Business Days ['
                 || cast(doc_id % 6 as string) || '], or in ' || cast(doc_id % 4 + 3 as string) || ' days'
                 || case when doc_id % 5 = 0 then '.' else ' [2][1].' end as draft,
               cast(100 + doc_id % 900 as bigint) as input_tokens, cast(50 + doc_id % 150 as bigint) as output_tokens,
               case doc_id % 3 when 0 then 'small' when 1 then 'large' else 'other' end as model,
               cast(doc_id % 40 as double) / 10 as latency_s,
               doc_id % 4 = 0 as needs_review
        from documents""",
    # Replies of a judge: mostly JSON inside text, some without JSON or without the verdict.
    "judgment_rows": """
        select doc_id as complaint_id, case when doc_id % 2 = 0 then 'rag' else 'no_rag' end as condition,
               case when doc_id % 11 = 0 then 'I cannot say, it''s "unclear"' || chr(10) || 'to me'
                    when doc_id % 11 = 1 then '{"accuracy": 3, "tone": 2}'
                    when doc_id % 11 = 2 then '{"accuracy": 3, "hallucination": tru}'
                    else 'Verdict: {"accuracy": ' || cast(1 + quality * 3 as string) || ', "grounding": '
                      || cast(2 + quality * 2 + toxic as string) || ', "tone": ' || cast(4 - toxic as string)
                      || ', "hallucination": '
                      || case when toxic = 1 then 'true' when quality = 0 then '"false"'
                              when doc_id % 11 = 3 then '0' when doc_id % 11 = 4 then 'null' else 'false' end
                      || ', "note": "checked ' || cast(doc_id as string) || '"} done' end as raw,
               case when doc_id % 22 = 0 then null else 'end_turn' end as stop_reason
        from labels""",
    "log": """
        select event_id, ts, case when event_type = 'purchase' then 'draft' else 'predict' end as endpoint,
               event_type as product, cast(k as double) / 100 as confidence, k < 60 as needs_review,
               value as latency_ms, cast(20 + user_id as bigint) as narrative_len,
               case when event_type = 'purchase' then k % 4 <> 0 end as citation_ok,
               case when event_type = 'purchase' then k < 60 or k % 4 = 0 end as flag_for_review,
               case when event_type = 'purchase' then value * 10 end as draft_latency_ms,
               case when event_type = 'purchase' then value / 10000 end as draft_cost_usd
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e""",
    "train_dist": """
        select event_type as category, cast(count(*) as double) / sum(count(*)) over () as share
        from events where cast(ts as date) < date '2024-01-15' group by event_type""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in `sf_dir`, or the table itself."""
    for table in TABLES:
        if table == name or re.search(rf"\b{table}\b", VIEWS.get(name, "")):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(VIEWS[name]) if name in VIEWS else spark.table(name)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "chunk_rows")
    return rows.withColumn("products", F.split("product_list", r"\|")).drop("product_list")


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """The query `body` after the named views and any further named queries."""
    parts = {n: VIEWS[n] for n in names} | (extra or {})
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in parts.items()) + "\n" + body
