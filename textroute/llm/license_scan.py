"""Licence scan by digests of canonical texts.

A text's canonical form has no copyright lines, one case, one blank between words, no punctuation and
one spelling for words that licences spell in several ways. Its SHA-256 is joined with the digests
of known licences by equality, once for the document's entire text and once for the entire text of
each of its lines, so that a notice standing on a line of its own is found as well.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textroute.llm.license_texts import NOTICES, SPELLINGS, TEXTS
from textroute.llm.registry import query, table
from textroute.session import materialize

#: A line that begins as a copyright statement or says that all rights are reserved.
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n©]*(?:copyright\b|©|\(c\)|all rights reserved)[^\n]*$"
NOT_A_WORD = r"[^\p{L}\p{N}]+"
VARIANT = r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + r")\b"


def with_digest(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """`df` with the SHA-256 of a text's canonical form in place of the text; null if no word is left.

    Each step is a column of its own, so that none is evaluated more than once a row.
    """
    same = F.map_from_arrays(F.array(*[F.lit(a) for a, _ in SPELLINGS]), F.array(*[F.lit(b) for _, b in SPELLINGS]))
    spelled = F.array_join(F.transform(F.split("plain", " "), lambda w: F.coalesce(same[w], w)), " ")
    lower = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), COPYRIGHT_LINE, ""))
    return (df.withColumn("plain", F.trim(F.regexp_replace(lower, NOT_A_WORD, " ")))
            .withColumn("form", F.when(F.col("plain").rlike(VARIANT), spelled).otherwise(F.col("plain")))
            .withColumn(name, F.when(F.col("form") != "", F.sha2("form", 256))).drop("plain", "form", text))


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in table `(license_id, text)`."""
    return spark.createDataFrame(TEXTS + NOTICES, "license_id string, text string")


def scan(df: DataFrame, licenses: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, digest, license_id, notices, notice_lines)`, one row for each row of `df`.

    `license_id` is the licence that is the document's entire text, `notices` the licences that single lines of a longer text
    name in full (sorted, joined by `;`, empty if none), `notice_lines` the number of such lines. A null or wordless text has a
    null digest and no licence. If a licence table gives one text two ids, the smaller counts. Rows that share an
    id and a digest share their notices, since they are the same text; a null id is an id like any other.
    Nothing but id and text is read.
    """
    known = materialize(with_digest(licenses.select("license_id", "text"), "known").filter("known is not null")
                        .groupBy("known").agg(F.min("license_id").alias("license_id")), "licenses")
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    lines = rows.filter("instr(text, '\n') > 0").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    notes = (with_digest(lines, "known", "line").join(known, "known")
             .select("doc_id", "text_hash", "line_no", "license_id").distinct()
             .groupBy("doc_id", "text_hash").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ";").alias("notices"),
                                                 F.count("*").alias("notice_lines")))
    docs = with_digest(rows.withColumn("text_hash", F.xxhash64("text")), "digest")
    whole = docs.join(known, F.col("digest") == F.col("known"), "left").drop("known")
    notes = notes.select(F.col("doc_id").alias("note_id"), F.col("text_hash").alias("note_hash"), "notices", "notice_lines")
    joined = whole.join(notes, F.col("doc_id").eqNullSafe(F.col("note_id")) & (F.col("text_hash") == F.col("note_hash")), "left")
    return joined.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"),
                         F.coalesce("notice_lines", F.lit(0)).cast("long").alias("notice_lines"))


def _sql_canonical(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    plain = f"trim(regexp_replace(lower(regexp_replace(coalesce({text}, ''), {q(COPYRIGHT_LINE)}, '', 'g')), {q(NOT_A_WORD)}, ' ', 'g'))"
    same = "map {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in SPELLINGS) + "}"
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce({same}[w], w)), ' ')"


def _sql_digest(text: str) -> str:
    return f"case when {_sql_canonical(text)} <> '' then sha256({_sql_canonical(text)}) end"


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(i)}, {q(t)})" for i, t in TEXTS + NOTICES)
    return f"""
with known as (select known, min(license_id) as license_id
  from (select {_sql_digest('t')} as known, license_id from (values {values}) v(license_id, t)) group by known),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where instr(text, chr(10)) > 0),
notes as (select doc_id, array_to_string(list_sort(list(distinct license_id)), ';') as notices, count(*) as notice_lines
  from (select doc_id, {_sql_digest('line')} as known from lines) join known using (known) group by doc_id),
docs as (select doc_id, {_sql_digest('text')} as digest from documents)
select d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') as notices, coalesce(n.notice_lines, 0) as notice_lines
from docs d left join known k on d.digest = k.known left join notes n on d.doc_id = n.doc_id"""


@query("op1_license_digest_scan", _oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, the licence it is and the notices it holds."""
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))
