"""Redaction of personal data and checks of drafted replies."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import unicode_pattern
from ..functions.text import DIGIT, EDGE, WORD, all_matches

# What counts as personal data, in the order in which it is replaced.
PII_PATTERNS = {
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b",
    "card": r"\b(?:\d[ -]?){13,19}\b",
    "account": r"(?i)\b(?:acct|account)\s*(?:#|no\.?|number)?\s*:?\s*\d{6,}\b",
    "long_digits": r"\b\d{8,}\b",
}

# A citation and a timeline in a drafted reply.
CITATION = r"\[(\d+)\]"
TIMELINE = r"(?i)\b(\d+)\s*(?:business\s+)?days?\b"

# The same for the engine: a boundary before a digit is looked for at digits only.
_TIMELINE = unicode_pattern(TIMELINE).replace(EDGE, rf"(?={DIGIT})(?<!{WORD})", 1)

_LARGEST = 9223372036854775807


# Necessary for every pattern but the first: five digits with at most two separators between neighbours.
_DIGIT_RUN = DIGIT + r"(?:[-). ]{0,2}" + DIGIT + "){4}"


def redacted(c: Column) -> Column:
    """The text with every pattern replaced by `[NAME]`, one after the other.

    Most texts hold nothing to replace; two cheap looks at the original skip the patterns for them.
    """
    def replaced(text: Column, names: list[str]) -> Column:
        for name in names:
            text = F.regexp_replace(text, unicode_pattern(PII_PATTERNS[name]), f"[{name.upper()}]")
        return text

    first, *rest = PII_PATTERNS
    text = F.when(F.contains(c, F.lit("@")), replaced(c, [first])).otherwise(c)
    return F.when(c.rlike(_DIGIT_RUN), replaced(text, rest)).otherwise(text)


def redact_pii(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Replace personal data in `text` and add `pii_counts`, the non-zero number of hits per pattern.

    No pattern can match across a tag that is already in the text, so the hits of a pattern are
    the tags after redaction less those before. The patterns thus run once per text, and a filter
    on the counts does not multiply them when it is pushed down.
    """
    names = list(PII_PATTERNS)

    def tags(c: str, name: str) -> Column:
        tag = f"[{name.upper()}]"
        shorter = F.length(F.replace(F.col(c), F.lit(tag), F.lit("")))
        return ((F.length(c) - shorter) / len(tag)).cast("long")

    counts = F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                               F.array(*[tags(text, n) - tags("_before", n) for n in names]))
    return (df.withColumn("_before", F.col(text)).withColumn(text, redacted(F.col(text)))
              .withColumn("pii_counts", F.map_filter(counts, lambda k, v: v > 0)).drop("_before"))


def pii_profile(df: DataFrame, text: str = "narrative") -> DataFrame:
    """`(pattern, hits, rows)` over the whole table, for patterns that occur."""
    row = redact_pii(df.select(text), text).agg(*[
        F.struct(F.sum(F.coalesce(F.try_element_at("pii_counts", F.lit(n)), F.lit(0))).alias("hits"),
                 F.count(F.try_element_at("pii_counts", F.lit(n))).alias("rows")).alias(n) for n in PII_PATTERNS])
    totals = [F.struct(F.lit(n).alias("pattern"), F.col(f"{n}.hits").alias("hits"), F.col(f"{n}.rows").alias("rows"))
              for n in PII_PATTERNS]
    return row.select(F.inline(F.array(*totals))).filter("hits > 0")


def cited_numbers(draft: Column) -> Column:
    """Distinct cited numbers, ascending. One too large for a long counts as the largest long."""
    number = lambda s: F.coalesce(s.try_cast("bigint"), F.lit(_LARGEST))
    return F.array_sort(F.array_distinct(F.transform(all_matches(draft, unicode_pattern(CITATION), 1), number)))


def check_citations(df: DataFrame, draft: str = "draft", chunk_texts: str = "chunk_texts") -> DataFrame:
    """Add `citations`: cited and invalid numbers, timelines without support, and `ok`.

    A timeline is supported when the validly cited chunks, joined by a space, name the same number
    of days. Without chunks every citation is invalid, and a null draft cites nothing: neither is ok. All
    steps are expressions over the row's own arrays.
    """
    df = df.withColumn("_chunks", F.coalesce(chunk_texts, F.array().cast("array<string>")))
    n = F.size("_chunks")
    text = F.coalesce(F.col(draft), F.lit(""))
    valid = F.filter("_cited", lambda i: (i >= 1) & (i <= n))
    cited_text = F.lower(F.array_join(F.transform(valid, lambda i: F.element_at("_chunks", i.cast("int"))), " "))
    days = lambda phrase: F.regexp_extract(phrase, rf"^{DIGIT}+", 0)
    unsupported = F.transform(F.filter("_claims", lambda phrase: ~F.array_contains("_supported", days(phrase))), F.lower)
    report = F.struct(
        F.col("_cited").alias("cited"),
        F.filter("_cited", lambda i: (i < 1) | (i > n)).alias("invalid"),
        F.col("_unsupported").alias("unsupported_timelines"),
        ((F.size("_cited") > 0) & (F.size(F.filter("_cited", lambda i: (i < 1) | (i > n))) == 0)
         & (F.size("_unsupported") == 0)).alias("ok"))
    return (df.withColumn("_cited", cited_numbers(F.coalesce(F.col(draft), F.lit(""))))
              .withColumn("_claims", all_matches(text, _TIMELINE))
              .withColumn("_supported", all_matches(cited_text, _TIMELINE, 1))
              .withColumn("_unsupported", unsupported)
              .withColumn("citations", report)
              .drop("_chunks", "_cited", "_claims", "_supported", "_unsupported"))
