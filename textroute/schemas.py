"""Declared schemas and the constants of the data contract."""
from __future__ import annotations

from pyspark.sql import types as T

# Headers of the raw export, in file order.
RAW_HEADERS = [
    "Date received",
    "Product",
    "Sub-product",
    "Issue",
    "Sub-issue",
    "Consumer complaint narrative",
    "Company public response",
    "Company",
    "State",
    "ZIP code",
    "Tags",
    "Consumer consent provided?",
    "Submitted via",
    "Date sent to company",
    "Company response to consumer",
    "Timely response?",
    "Consumer disputed?",
    "Complaint ID",
]

# Clean column name for each raw header that is kept.
RENAMES = {
    "date_received": "Date received",
    "product": "Product",
    "sub_product": "Sub-product",
    "issue": "Issue",
    "sub_issue": "Sub-issue",
    "narrative": "Consumer complaint narrative",
    "company": "Company",
    "state": "State",
    "submitted_via": "Submitted via",
    "company_response": "Company response to consumer",
    "timely_response": "Timely response?",
    "complaint_id": "Complaint ID",
}

# Superseded product labels and the label that replaced each.
CURRENT_LABELS = {
    "Credit card or prepaid card": "Credit card",
    "Credit reporting": "Credit reporting or other personal consumer reports",
    "Credit reporting, credit repair services, or other personal consumer reports":
        "Credit reporting or other personal consumer reports",
    "Money transfers": "Money transfer, virtual currency, or money service",
    "Payday loan, title loan, or personal loan":
        "Payday loan, title loan, personal loan, or advance loan",
}

# Cell texts that a pandas CSV reader takes as missing by default.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

MIN_NARRATIVE_CHARS = 20
EARLIEST_DATE = "2011-01-01"

CATEGORICALS = [
    "product", "sub_product", "issue", "sub_issue", "company", "state",
    "submitted_via", "company_response", "timely_response",
]

RAW_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in RAW_HEADERS])

CLEAN_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.LongType(), False),
    T.StructField("date_received", T.DateType(), False),
    T.StructField("product", T.StringType(), False),
    T.StructField("sub_product", T.StringType()),
    T.StructField("issue", T.StringType()),
    T.StructField("sub_issue", T.StringType()),
    T.StructField("narrative", T.StringType(), False),
    T.StructField("company", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("submitted_via", T.StringType()),
    T.StructField("company_response", T.StringType()),
    T.StructField("timely_response", T.StringType()),
    T.StructField("narrative_len", T.IntegerType(), False),
])

LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("needs_review", T.BooleanType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("narrative_len", T.LongType()),
    T.StructField("citation_ok", T.BooleanType()),
    T.StructField("flag_for_review", T.BooleanType()),
    T.StructField("draft_latency_ms", T.DoubleType()),
    T.StructField("draft_cost_usd", T.DoubleType()),
])

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("products", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
])
