import math
from collections import Counter

import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from textroute.operators import drafting, guardrails, judging, retrieval
from textroute.sources import files

PAGES = {
    "00_general.md": "---\ntitle: General standards\nproducts: all\n---\n# Standards\n\nWe answer every complaint within 15 days of receipt, in writing.\n\nshort\n\nDo not ask for a full account number or for a password in any reply.\n",
    "01_cards.md": "---\ntitle: Cards: disputes\nproducts: Credit card | Prepaid card\n---\n\n# Cards\nnot a paragraph of its own, as it follows the heading line\n\nWe investigate a disputed card charge within 10 business days.\n \nProvisional credit for a disputed charge is given within 45 days.\n",
    "02_plain.md": "No header here, but a paragraph that is long enough to keep.",
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name, text in PAGES.items():
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "notes.txt").write_text("ignored")
    return retrieval.chunk_paragraphs(files.scan_corpus(spark, str(folder)))


def test_paragraphs_keep_gaps_and_defaults(corpus):
    got = {r["id"]: r for r in corpus.collect()}
    assert set(got) == {"00_general#0", "00_general#2", "01_cards#0", "01_cards#1", "02_plain#0"}
    assert got["01_cards#0"]["title"] == "Cards: disputes"
    assert got["01_cards#0"]["products"] == ["Credit card", "Prepaid card"]
    assert got["02_plain#0"]["title"] == "02_plain" and got["02_plain#0"]["products"] == ["all"]


def test_last_of_equal_header_keys_wins(spark):
    raw = "---\ntitle: one\nno colon\ntitle: two: b\n---\nbody\n"
    row = retrieval.parse_front_matter(spark.createDataFrame([("p.md", raw)], "source string, raw string")).first()
    assert row["meta"] == {"title": "two: b"} and row["body"] == "body\n"


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, text string, product string")


def test_search_respects_the_product_and_keeps_zero_scores(spark, corpus):
    index = retrieval.build_index(corpus)
    q = queries(spark, (1, "a disputed charge, 10 business days", "Credit card"), (2, "zzz", "Credit card"),
                (3, "disputed charge", "Unknown"), (4, "disputed charge", None), (5, "disputed charge", ""))
    got = {}
    for r in retrieval.search(q, index, k=12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got[1][0][0] == "01_cards#0" and len(got[1]) == 5
    assert [i for i, s in got[2]] == ["00_general#0", "00_general#2", "01_cards#0", "01_cards#1", "02_plain#0"]
    assert all(s == 0 for _, s in got[2])
    assert {i for i, _ in got[3]} == {"00_general#0", "00_general#2", "02_plain#0"}
    assert len(got[4]) == len(got[5]) == 5
    assert [r["n_candidates"] for r in retrieval.candidate_counts(q, index).orderBy("query_id").collect()] == [5, 5, 3, 5, 5]


def plain_bm25(texts, query):
    docs = [regex.findall("[a-z0-9]+", t.lower()) for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean))
                       for t in regex.findall("[a-z0-9]+", query.lower()) if t in idf))
    return out


@pytest.mark.parametrize("block_chunks", [5000, 2])
def test_scores_match_a_plain_ranking(spark, block_chunks):
    texts = ["the bank will reply", "the card was charged the wrong fee", "fee fee fee", "the reply to the fee dispute", "unrelated words", ""]
    chunks = spark.createDataFrame([(f"c#{i}", "c", "t", ["all"], t, i) for i, t in enumerate(texts)],
                                   "id string, source string, title string, products array<string>, text string, position int")
    asked = ["the fee, the FEE and the reply", "bank", "nothing", "the"]
    index = retrieval.build_index(chunks, block_chunks=block_chunks)
    assert index.n_blocks == (1 if block_chunks == 5000 else 3)
    q = queries(spark, *[(i, t, None) for i, t in enumerate(asked)])
    got = {}
    for r in retrieval.search(q, index, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for i, text in enumerate(asked):
        scores = plain_bm25(texts, text)
        want = sorted(range(len(texts)), key=lambda j: (-round(scores[j], 9), j))[:4]
        assert [x for x, _ in got[i]] == [f"c#{j}" for j in want]
        assert [s for _, s in got[i]] == pytest.approx([scores[j] for j in want])


def test_search_shuffles_only_the_raw_queries(spark, corpus):
    index = retrieval.build_index(corpus)
    plan = retrieval.search(queries(spark, (1, "fee", None)), index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def test_vector_search_in_blocks_equals_one_block(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200, [0.0] * 8)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.withColumnRenamed("id", "query_id")
    one = retrieval.vector_search(q, v, k=3).orderBy("query_id", "rank").collect()
    many = retrieval.vector_search(q, v, k=3, block=40).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["id"]) for r in one] == [(r["query_id"], r["rank"], r["id"]) for r in many]
    assert len(one) == 603 and one[0]["id"] == 0 and one[0]["score"] == pytest.approx(1.0)
    named = retrieval.vector_search(q, v.withColumn("id", F.concat(F.lit("page#"), "id")), k=1).filter("query_id = 7").first()
    assert named["id"] == "page#7"


def test_cosine_search_keeps_the_contract(spark, corpus):
    index = retrieval.build_index(corpus, weights=retrieval.cosine_weights)
    asked = queries(spark, (1, "fee", None), (2, "nothing known here zzz", None))
    hits = retrieval.cosine_search(asked, index, k=3).orderBy("query_id", "rank").collect()
    assert [r["rank"] for r in hits] == [1, 2, 3, 1, 2, 3]
    assert all(0 <= r["score"] <= 1 + 1e-12 for r in hits)
    assert {r["id"] for r in hits} <= {r["id"] for r in corpus.collect()}


def test_citations_fail_closed(spark):
    df = spark.createDataFrame([(1, "See [5].", None), (2, "See [1].", []), (3, None, ["a"]), (4, "See [1].", ["a"]), (5, "no citation", ["a"])],
                               "id int, draft string, chunk_texts array<string>")
    got = {r["id"]: r["citations"] for r in guardrails.check_citations(df).collect()}
    assert {i: c["ok"] for i, c in got.items()} == {1: False, 2: False, 3: False, 4: True, 5: False}
    assert got[1]["invalid"] == [5] and got[2]["invalid"] == [1]


def test_the_last_verdict_counts(spark):
    drafts = spark.createDataFrame([(1, "rag"), (2, "rag")], "complaint_id long, condition string")
    cache = spark.createDataFrame([(1, "rag", 1, 2.0), (1, "rag", 2, 5.0), (2, "rag", 3, 1.0)], "complaint_id long, condition string, line int, accuracy double")
    got = {r["complaint_id"]: r["accuracy"] for r in judging.merge_judgments(drafts, cache, "line").collect()}
    assert got == {1: 5.0, 2: 1.0}


def redact(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, narrative string")
    return [(r["narrative"], r["pii_counts"]) for r in guardrails.redact_pii(df).orderBy("id").collect()]


def test_redaction_of_the_usual_kinds(spark):
    (text, counts), = redact(spark, "call me at 410-555-1234 or jane@example.com, SSN 123-45-6789, acct 123456789")
    assert all(tag in text for tag in ("[PHONE]", "[EMAIL]", "[SSN]")) and "555" not in text and "example.com" not in text
    assert counts["phone"] == 1


def test_redaction_matches_sequential_substitution(spark):
    texts = ["é1234567890123456 4111 1111 1111 1111 and 41111111é", "Account No. : 1234567 ACCT#99887766 account 12345",
             "x@y.zé jürgen@müller.de a_b+c@d-e.fg.", "1-800-555-1234 (800)555 1234 ٠١٢٣٤٥٦٧٨ 12345678901234567890123", "nothing", "",
             "no digits but a.b@c.d and 5"]
    got = redact(spark, *texts)
    for text, (shown, counts) in zip(texts, got):
        want, hits = text, {}
        for name, pattern in guardrails.PII_PATTERNS.items():
            want, n = regex.subn(pattern, f"[{name.upper()}]", want)
            if n:
                hits[name] = n
        assert (shown, counts) == (want, hits)
    plain = spark.createDataFrame([(t,) for t in texts], "t string").select(guardrails.redacted(F.col("t")))
    assert [r[0] for r in plain.collect()] == [shown for shown, _ in got]


CHUNKS = ["We investigate within 10 business days.", "Provisional credit within 45 days."]


@pytest.mark.parametrize("draft, cited, invalid, unsupported, ok", [
    ("We will investigate within 10 business days [1].", [1], [], [], True),
    ("We will respond within 3 days [1].", [1], [], ["3 days"], False),
    ("See [5].", [5], [5], [], False),
    ("We will look into it.", [], [], [], False),
    ("In 45 Days [1], in 45 days [2] [2] [1].", [1, 2], [], [], True),
    ("In 45 DAYS [1] or 1 day.", [1], [], ["45 days", "1 day"], False),
    ("Within 7 to 10 business days [1] [0].", [0, 1], [0], [], False),
    ("Sure [99999999999999999999].", [9223372036854775807], [9223372036854775807], [], False),
])
def test_citation_cases(spark, draft, cited, invalid, unsupported, ok):
    df = spark.createDataFrame([(draft, CHUNKS)], "draft string, chunk_texts array<string>")
    rep = guardrails.check_citations(df).first()["citations"]
    assert (rep["cited"], rep["invalid"], rep["unsupported_timelines"], rep["ok"]) == (cited, invalid, unsupported, ok)


def test_prompt_to_report(spark, corpus):
    index = retrieval.build_index(corpus)
    records = spark.createDataFrame([(1, "Credit card", "Someone disputed a charge, call 410-555-1234"), (1234567, "Unknown", "hello")],
                                    "complaint_id long, product string, narrative string")
    prompts = drafting.build_prompts(records, index, k=3).orderBy("complaint_id").collect()
    assert prompts[0]["case_ref"] == "NB-000001" and prompts[1]["case_ref"] == "NB-1234567"
    assert "[PHONE]" in prompts[0]["prompt"] and "[1] (Cards: disputes) We investigate" in prompts[0]["prompt"]
    assert len(prompts[0]["chunks"]) == 3
    bare = drafting.build_prompts(records, None).first()
    assert "no policy excerpts" in bare["prompt"]

    reply = "Dear Customer, we will investigate within 10 business days [1]."

    def fake():
        return lambda p: pd.DataFrame({"draft": [reply] * len(p), "input_tokens": 900, "output_tokens": 180})

    rows = drafting.build_prompts(records, index, k=3)
    drafts = drafting.generate_batch(rows, fake).withColumn("model", F.lit("m")).join(rows.select("complaint_id", "chunks"), "complaint_id")
    prices = spark.createDataFrame([("m", 1.0, 5.0)], "model string, input_per_m double, output_per_m double")
    out = drafting.cost_usd(drafting.draft_report(drafts), prices).orderBy("complaint_id").collect()
    assert out[0]["draft"] == reply and out[0]["citations"]["ok"] and not out[1]["citations"]["ok"]
    assert out[0]["cost_usd"] == pytest.approx((900 * 1 + 180 * 5) / 1e6)
    unknown = drafting.cost_usd(drafts.withColumn("model", F.lit("?")), prices).first()
    assert unknown["cost_usd"] == 0


def test_judgments_follow_truthiness(spark):
    cases = [("true", True), ("false", False), ('"false"', True), ('""', False), ("0", False), ("0.5", True), ("null", False),
             ("[]", False), ("[0]", True)]
    rows = [(i, "say " + '{"accuracy": 4, "hallucination": ' + v + ', "note": "n"}' + " end {}", "end") for i, (v, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "complaint_id long, raw string, stop_reason string")
    got = judging.parse_judgment(df).orderBy("complaint_id").collect()
    assert [r["hallucination"] for r in got] == [w for _, w in cases]
    assert got[0]["accuracy"] == 4.0 and got[0]["grounding"] is None and got[0]["note"] == "n"


def test_unparseable_judgments_note_the_reply(spark):
    replies = ["it's \"so\"\nso", "it's", 'a "b" \\', "x" * 600, '{"accuracy": 3}', '{"hallucination": tru}', ""]
    df = spark.createDataFrame([(i, r, None if i else "max_tokens") for i, r in enumerate(replies)], "complaint_id long, raw string, stop_reason string")
    got = judging.parse_judgment(df).orderBy("complaint_id").collect()
    for i, (reply, r) in enumerate(zip(replies, got)):
        assert r["hallucination"] is None and r["accuracy"] is None
        assert r["note"] == f"unparseable ({'?' if i else 'max_tokens'}): {reply[:80]!r}"
        assert r["raw"] == reply[:500]


def test_eval_set_quotas(spark):
    preds = spark.range(1000).select(F.col("id").alias("complaint_id"), F.when(F.col("id") < 980, "A").when(F.col("id") < 998, "B").otherwise("C").alias("product"))
    out = judging.stratified_eval_set(preds, n=100)
    n = {r["product"]: r["n"] for r in out.groupBy("product").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 100 and n["B"] <= 3 and n.get("C", 0) <= 2 and n["A"] >= 95
    again = judging.stratified_eval_set(preds.repartition(7), n=100)
    assert {r[0] for r in again.select("complaint_id").collect()} == {r[0] for r in out.select("complaint_id").collect()}


def test_cache_resume(spark):
    cache = spark.createDataFrame([(1, 0, "old"), (1, 5, "new"), (2, 1, "x")], "complaint_id long, line long, draft string")
    latest = {r["complaint_id"]: r["draft"] for r in judging.latest_rows(cache, "line", "complaint_id").collect()}
    assert latest == {1: "new", 2: "x"}
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "complaint_id long")
    assert [r[0] for r in judging.pending_rows(wanted, cache, "complaint_id").collect()] == [3]
