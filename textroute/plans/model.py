"""Queries over features, the linear model, evaluation, explanation and slices."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, explanation, features, linear
from ..operators.splitting import guarded_split
from ..session import materialize, work_path
from ..sources import files
from .prep import SPACE_SQL, split_sql
from .registry import query, rounded
from .views import CLASSES, view, with_ctes

# Fixed numbers of the registered queries, shared by both sides.
WORD_CAP = 5000

TERMS = {
    "word_tokens": r"select complaint_id, regexp_extract_all(lower(narrative), '[\p{L}\p{N}_]{2,}') as t from complaints",
    "word_list": """select complaint_id, unnest(list_concat(t, list_transform(range(1, len(t)),
                    lambda i: t[i] || ' ' || t[i + 1]))) as term from word_tokens""",
    "word_terms": "select complaint_id, term, count(*) as tf from word_list group by all",
}

CHARS = {
    "char_words": rf"""select complaint_id, ' ' || w || ' ' as w, count(*) as n from (
        select complaint_id, unnest(regexp_extract_all(lower(narrative), '[^\s\x0B\x1C-\x1F\x85\p{{Z}}]+')) as w
        from complaints) group by all""",
    "char_sizes": "select complaint_id, w, n, unnest(range(3, least(5, length(w)) + 1)) as size from char_words",
    "char_terms": """select complaint_id, term, sum(n)::bigint as tf from (
        select complaint_id, n, substring(w, i, size) as term from (
            select *, unnest(range(1, length(w) - size + 2)) as i from char_sizes)) group by all""",
}


def _weighted(block: str, min_df: int, cap: int | None = None) -> dict[str, str]:
    """Vocabulary, idf and weights of one block."""
    limit = f" order by total_tf desc, term limit {cap}" if cap else ""
    return {
        f"{block}_vocab": f"""select term, count(*) as df, sum(tf)::bigint as total_tf from {block}_terms
            group by term having count(*) >= {min_df}{limit}""",
        f"{block}_idf": f"""select *, ln((1.0::double + (select count(*) from complaints)) / (1.0::double + df)) + 1 as idf
            from {block}_vocab""",
        f"{block}_weighted": f"""select complaint_id, '{block}' as block, term, (1 + ln(tf::double)) * idf as weight
            from {block}_terms join {block}_idf using (term)""",
        f"{block}_values": f"""select complaint_id, block, term,
            weight / sqrt(sum(weight * weight) over (partition by complaint_id)) as value from {block}_weighted""",
    }


WORD_VALUES = TERMS | _weighted("word", 3, features.MAX_FEATURES["word"])
CHAR_VALUES = CHARS | _weighted("char", 5, features.MAX_FEATURES["char"])


def _complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "complaints").select("complaint_id", "date_received", "product", "narrative",
                                                    "company", "submitted_via", "narrative_len")


@query("word_terms", with_ctes(["complaints"], "select * from word_terms", TERMS))
def _(spark, sf_dir):
    return features.word_terms(_complaints(spark, sf_dir))


@query("char_terms", with_ctes(["complaints"], """
    select complaint_id, length(term)::int as size, count(*) as n_terms, sum(tf)::bigint as tf,
           md5(string_agg(term || ':' || tf, '|' order by term)) as terms_md5 from char_terms group by all""", CHARS))
def _(spark, sf_dir):
    """Per record and gram size, with a digest over all its grams and counts."""
    terms = features.term_arrays(_complaints(spark, sf_dir), blocks=("char",))
    sized = terms.select("complaint_id", F.explode(F.array(*map(F.lit, (3, 4, 5)))).alias("size"), "terms").withColumn(
        "terms", F.filter("terms", lambda x: F.length(x["term"]) == F.col("size"))).filter(F.size("terms") > 0)
    return sized.select("complaint_id", "size", F.size("terms").cast("long").alias("n_terms"),
                        F.aggregate("terms", F.lit(0).cast("long"), lambda n, x: n + x["tf"]).alias("tf"),
                        F.md5(F.array_join(F.transform("terms", lambda x: F.concat(x["term"], F.lit(":"), x["tf"].cast("string"))), "|").cast("binary")).alias("terms_md5"))


_VOCAB = TERMS | CHARS | _weighted("word", 3, WORD_CAP) | _weighted("char", 5, WORD_CAP)


@query("vocabulary", with_ctes(["complaints"], """
    select 'word' as block, term, df, total_tf from word_vocab
    union all select 'char', term, df, total_tf from char_vocab""", _VOCAB))
def _(spark, sf_dir):
    return features.text_vocabulary(_complaints(spark, sf_dir), max_features={"word": WORD_CAP, "char": WORD_CAP})


@query("vocabulary_default_cuts", with_ctes(["complaints"], """
    select 'word' as block, term, df, total_tf from word_vocab
    union all select 'char', term, df, total_tf from char_vocab""", WORD_VALUES | CHAR_VALUES))
def _(spark, sf_dir):
    return features.text_vocabulary(_complaints(spark, sf_dir))


def weighted_vocabulary(df: DataFrame, blocks: tuple[str, ...] = ("word",)) -> DataFrame:
    """The vocabulary of the blocks at the default cuts, with its idf."""
    frequent = features.text_vocabulary(df, blocks=blocks)
    return materialize(features.with_idf(frequent, df.count()), "vocabulary")


@query("tfidf", with_ctes(["complaints"], """
    select complaint_id, block, term, round(value, 6) as value from word_values
    union all select complaint_id, block, term, round(value, 6) from char_values""", WORD_VALUES | CHAR_VALUES))
def _(spark, sf_dir):
    """Words and characters, as the reference's features are."""
    df = _complaints(spark, sf_dir)
    return rounded(features.text_tfidf(df, weighted_vocabulary(df, ("word", "char"))), "value")


@query("class_weights", with_ctes(["complaints"], """
    select product, n, round((select count(*) from complaints)::double / ((select count(*) from c) * n), 6) as balanced,
           round(1.0::double / n / (select avg(1.0::double / n) from c), 6) as inverse_frequency from c""",
    {"c": "select product, count(*) as n from complaints group by product"}))
def _(spark, sf_dir):
    return rounded(features.class_weights(_complaints(spark, sf_dir)), "balanced", "inverse_frequency")


# A fixed coefficient table: class mean of a term's value less its mean over all records, times a factor
# that spreads the probabilities, so that every class is predicted and confidence lies on both sides of the threshold.
SPREAD = 20.0

INTERCEPTS = {"de": 0.1, "en": 0.4, "es": -0.2, "fr": 0.0}


def _model_sql(blocks: list[str]) -> dict[str, str]:
    values = " union all ".join(f"select * from {b}_values" for b in blocks)
    weighted = " union all ".join(f"select * from {b}_weighted" for b in blocks)
    base = ", ".join(f"('{c}', {b}::double)" for c, b in INTERCEPTS.items())
    return {
        "vals": values, "weighted": weighted,
        "classes": f"select * from (values {base}) v(class, b)",
        "sizes": "select product as class, count(*) as n from complaints group by product",
        "overall": "select block, term, sum(value) / (select count(*) from complaints) as mean from vals group by all",
        "per_class": """select product as class, block, term, sum(value) as total from vals
                        join complaints using (complaint_id) group by all""",
        "coef": f"""select classes.class, o.block, o.term, {SPREAD}::double * (coalesce(p.total, 0) / sizes.n - o.mean) as w
                   from overall o cross join classes join sizes using (class)
                   left join per_class p on p.class = classes.class and p.block = o.block and p.term = o.term""",
        "logits": """select c.complaint_id, k.class, any_value(k.b) + coalesce(sum(v.value * f.w), 0) as z
                     from complaints c cross join classes k
                     left join vals v on v.complaint_id = c.complaint_id
                     left join coef f on f.class = k.class and f.block = v.block and f.term = v.term
                     group by c.complaint_id, k.class""",
        "proba": """select complaint_id, class, exp(z - max(z) over w) / sum(exp(z - m)) over w as p
                    from (select *, max(z) over (partition by complaint_id) as m from logits)
                    window w as (partition by complaint_id)""",
    }


WORD_MODEL = WORD_VALUES | _model_sql(["word"])
FULL_MODEL = WORD_VALUES | CHAR_VALUES | _model_sql(["word", "char"])


def fixed_model(df: DataFrame, blocks: tuple[str, ...] = ("word",)) -> linear.LinearModel:
    """The same coefficient table in Spark."""
    vocab = weighted_vocabulary(df, blocks)
    sizes = {r["product"]: r["n"] for r in df.groupBy("product").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    of_class = {f"_{c}": F.col("product") == c for c in CLASSES}
    sums = features.term_sums(df, vocab, {"_all": F.lit(1.0)} | of_class, blocks=blocks).withColumn("mean", F.col("_all") / total)
    weights = [F.struct(F.lit(c).alias("class"), (SPREAD * (F.col(f"_{c}") / sizes[c] - F.col("mean"))).alias("w")) for c in CLASSES]
    coef = sums.select("block", "term", F.inline(F.array(*weights)))
    return linear.model_from_tables(coef, INTERCEPTS, vocab)


@query("predict_proba", with_ctes(["complaints"], "select complaint_id, class, round(p, 6) as p from proba", WORD_MODEL))
def _(spark, sf_dir):
    df = _complaints(spark, sf_dir)
    model = fixed_model(df)
    return rounded(linear.long_proba(linear.predict_proba(df, model), model.classes), "p")


@query("predict_proba_words_and_chars", with_ctes(["complaints"], "select complaint_id, class, round(p, 6) as p from proba", FULL_MODEL))
def _(spark, sf_dir):
    df = _complaints(spark, sf_dir)
    model = fixed_model(df, ("word", "char"))
    return rounded(linear.long_proba(linear.predict_proba(df, model), model.classes), "p")


@query("predict_label", with_ctes(["complaints"], """
    select complaint_id, class as pred, round(p, 6) as confidence from (
        select *, row_number() over (partition by complaint_id order by round(p, 9) desc, class) as r from proba) where r = 1""", WORD_MODEL))
def _(spark, sf_dir):
    df = _complaints(spark, sf_dir)
    model = fixed_model(df)
    return rounded(linear.predict(linear.predict_proba(df, model), model.classes), "confidence")


@query("route", with_ctes(["complaints"], """
    select complaint_id, max(class) filter (r = 1) as product, round(max(p) filter (r = 1), 3) as confidence,
           string_agg(class, ';' order by r) filter (r <= 3) as top3, max(p) filter (r = 1) < 0.6 as needs_review
    from (select *, row_number() over (partition by complaint_id order by round(p, 9) desc, class) as r from proba)
    group by complaint_id""", WORD_MODEL))
def _(spark, sf_dir):
    df = _complaints(spark, sf_dir)
    model = fixed_model(df)
    scored = linear.predict_proba(df, model)
    routed = linear.route(scored, model.classes).withColumn("top3", F.array_join(F.col("top3")["class"], ";"))
    exact = linear.predict(scored, model.classes).select("complaint_id", F.round("confidence", 3).alias("confidence"))
    return routed.drop("confidence").join(exact, "complaint_id")


_FIT_CLASS = 10
_FITTED = {"frequent": f"select product from guarded where split = 'train' group by product having count(*) >= {_FIT_CLASS}",
           "final": "select * from guarded where product in (select product from frequent)"}


@query("fit_linear", split_sql("""
    select complaint_id, split, product, 1.0::double as p_total, true as beats_majority from final where split <> 'train'""",
    "guarded", _FITTED))
def _(spark, sf_dir):
    """Train on the past with both blocks and the default cuts, then score what came later.

    Solvers differ in digits, so the SQL holds what any of them must give: a distribution for each record, and
    more right answers than the most frequent class would get.
    """
    rows = materialize(guarded_split(view(spark, sf_dir, "complaints"), min_class_count=_FIT_CLASS), "split")
    model = linear.fit(rows.filter("split = 'train'"))
    later = rows.filter("split <> 'train'")
    proba = materialize(linear.predict_proba(later, model), "proba")
    scored = later.select("complaint_id", "split", "product").join(proba, "complaint_id").join(
        linear.predict(proba, model.classes), "complaint_id")
    majority = rows.filter("split = 'train'").groupBy("product").count().orderBy(F.desc("count"), "product").first()["product"]
    right = scored.agg(F.avg((F.col("pred") == F.col("product")).cast("int")) > F.avg((F.col("product") == majority).cast("int"))).scalar()
    total = F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6)
    return scored.select("complaint_id", "split", "product", total.alias("p_total"), right.alias("beats_majority"))


@query("fit_certificate", split_sql("""
    select product as class, count(*) as n, round(sum(count(*)) over ()::double / count(*) over (), 6) as weight, true as mass_matches,
           true as is_optimum from final where split = 'train' group by product""", "guarded", _FITTED))
def _(spark, sf_dir):
    """The gradient of the penalised loss at the fitted weights, per class: zero, within the tolerance, at the optimum only.

    The solver stops at slopes of a tenth of the tolerance; `tol` only ends a fit that gains nothing any more.
    """
    rows = materialize(guarded_split(view(spark, sf_dir, "complaints"), min_class_count=_FIT_CLASS).filter("split = 'train'"), "train")
    told = linear.optimality(rows, linear.fit(rows, tol=1e-9, blocks=("word",)))
    flat = F.greatest(F.abs("intercept_slope"), "slope") <= linear.SLOPE_TOLERANCE
    near = F.abs(F.col("mass") - F.col("weight")) <= linear.SLOPE_TOLERANCE * F.col("weight") * F.count("*").over(Window.partitionBy())
    return rounded(told.select("class", "n", "weight", near.alias("mass_matches"), flat.alias("is_optimum")), "weight")


@query("save_and_load_model", with_ctes(["complaints"], "select complaint_id, class, round(p, 6) as p from proba", WORD_MODEL))
def _(spark, sf_dir):
    df = _complaints(spark, sf_dir)
    model = linear.load_model(spark, linear.save_model(fixed_model(df), work_path(spark, "model")))
    return rounded(linear.long_proba(linear.predict_proba(df, model), model.classes), "p")


# Evaluation over probabilities given by a formula.

_PROBA = {
    "scaled": "select complaint_id, " + ", ".join(f"{c} / (de + en + es + fr) as {c}" for c in CLASSES) + " from proba_wide",
    "long": " union all ".join(f"select complaint_id, '{c}' as class, {c} as p from scaled" for c in CLASSES),
    "best": """select complaint_id, class as pred, p as confidence from (
               select *, row_number() over (partition by complaint_id order by p desc, class) as r from long) where r = 1""",
    "preds": """select c.complaint_id, c.date_received, c.company, c.product, c.narrative, b.pred, c.product = b.pred as correct,
                b.confidence, l.p as p_true, c.narrative_len, c.submitted_via,
                case when c.complaint_id % 5 < 3 then 'val' else 'test' end as split,
                case when c.complaint_id % 2 = 0 then 'base' else 'wide' end as model
                from complaints c join best b using (complaint_id)
                join long l on l.complaint_id = c.complaint_id and l.class = c.product""",
}


def preds_sql(body: str, extra: dict[str, str] | None = None) -> str:
    return with_ctes(["complaints", "proba_wide"], body, _PROBA | (extra or {}))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _complaints(spark, sf_dir)
    aligned = evaluation.align_proba(records, view(spark, sf_dir, "proba_wide"), CLASSES)
    table = evaluation.predictions_table(aligned, CLASSES)
    return table.withColumns({
        "split": F.when(F.col("complaint_id") % 5 < 3, "val").otherwise("test"),
        "model": F.when(F.col("complaint_id") % 2 == 0, "base").otherwise("wide")})


@query("align_proba", preds_sql("select complaint_id, class, round(p, 6) as p from long"))
def _(spark, sf_dir):
    p = evaluation.align_proba(_complaints(spark, sf_dir), view(spark, sf_dir, "proba_wide"), CLASSES)
    return rounded(linear.long_proba(p, CLASSES), "p")


@query("scan_proba", with_ctes(["proba_wide"], " union all ".join(
    f"select complaint_id, '{c}' as class, {c} as p from proba_wide" for c in CLASSES)))
def _(spark, sf_dir):
    path = work_path(spark, "proba")
    view(spark, sf_dir, "proba_wide").write.parquet(path)
    return files.scan_proba(spark, path)


@query("predictions_table", preds_sql("""
    select complaint_id, date_received, company, product, narrative, pred, correct, round(confidence, 6) as confidence,
           round(p_true, 6) as p_true from preds"""))
def _(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).drop("split", "model"), "confidence", "p_true")


@query("accuracy", preds_sql("select round(avg(correct::int), 6) as accuracy from preds"))
def _(spark, sf_dir):
    return rounded(evaluation.accuracy(predictions(spark, sf_dir)), "accuracy")


def _f1_sql(by: str = "") -> dict[str, str]:
    key, on = (f"{by}, ", f" and q.{by} = k.{by}") if by else ("", "")
    keys = f"(select distinct {by} from preds) k cross join classes" if by else "classes k0 cross join (select 1 as one) k"
    return {
        "classes": "select unnest(['de', 'en', 'es', 'fr']) as class",
        "f1": f"""select {'k.' + by + ', ' if by else ''}class,
            count(*) filter (q.product = class)::bigint as support,
            coalesce(2.0::double * count(*) filter (q.product = class and q.pred = class)
              / nullif(count(*) filter (q.product = class) + count(*) filter (q.pred = class), 0), 0) as f1
            from {keys} left join preds q on (q.product = class or q.pred = class){on} group by all""",
        "avgs": f"""select {key}avg(f1) as macro_f1, sum(f1 * support) / sum(support) as weighted_f1
            from f1 {'group by ' + by if by else ''}""",
    }


@query("per_class_f1", preds_sql("select class, round(f1, 6) as f1, support from f1", _f1_sql()))
def _(spark, sf_dir):
    return rounded(evaluation.per_class_f1(predictions(spark, sf_dir), CLASSES), "f1")


@query("f1_averages", preds_sql("select round(macro_f1, 6) as macro_f1, round(weighted_f1, 6) as weighted_f1 from avgs", _f1_sql()))
def _(spark, sf_dir):
    return rounded(evaluation.f1_averages(predictions(spark, sf_dir), CLASSES), "macro_f1", "weighted_f1")


@query("log_loss", preds_sql("select round(avg(-ln(p_true)), 6) as log_loss from preds"))
def _(spark, sf_dir):
    return rounded(evaluation.log_loss(predictions(spark, sf_dir)), "log_loss")


@query("confusion_matrix", preds_sql("""
    select t.class as truth, p.class as pred, count(q.complaint_id) as n,
           round(coalesce(count(q.complaint_id)::double / nullif(sum(count(q.complaint_id)) over (partition by t.class), 0), 0), 6) as share
    from classes t cross join classes p left join preds q on q.product = t.class and q.pred = p.class
    group by t.class, p.class""", _f1_sql()))
def _(spark, sf_dir):
    return rounded(evaluation.confusion_matrix(predictions(spark, sf_dir), CLASSES), "share")


_EDGES = " + ".join(f"(confidence >= {i * 0.1!r}::double)::int" for i in range(1, 10))


@query("calibration", preds_sql(f"""
    select ({_EDGES})::int as bin, round(avg(confidence), 6) as mean_confidence,
           round(avg(correct::int), 6) as observed_accuracy, count(*) as n from preds group by 1"""))
def _(spark, sf_dir):
    return rounded(evaluation.calibration(predictions(spark, sf_dir)), "mean_confidence", "observed_accuracy")


@query("error_sample", preds_sql("""
    select complaint_id, product, pred, round(confidence, 6) as confidence from preds where not correct
    order by preds.confidence desc, complaint_id limit 50"""))
def _(spark, sf_dir):
    rows = evaluation.error_sample(predictions(spark, sf_dir))
    return rounded(rows.select("complaint_id", "product", "pred", "confidence"), "confidence")


@query("error_sample_seeded", preds_sql("""
    select complaint_id, product, pred from preds where not correct
    order by md5('7|' || complaint_id::varchar), complaint_id limit 50"""))
def _(spark, sf_dir):
    rows = predictions(spark, sf_dir).drop("confidence")
    return evaluation.error_sample(rows, seed=7).select("complaint_id", "product", "pred")


_EVALUATE = _f1_sql("run") | {
    "preds": "select *, model || ':' || split as run from preds0",
    "one": """select run, avg(correct::int) as accuracy, avg(-ln(p_true)) as log_loss from preds group by run""",
    "metrics": """select run, 'accuracy' as metric, accuracy as value from one
        union all select run, 'log_loss', log_loss from one union all select run, 'macro_f1', macro_f1 from avgs
        union all select run, 'weighted_f1', weighted_f1 from avgs
        union all select run, 'f1:' || class, f1 from f1 union all select run, 'support:' || class, support::double from f1""",
}
_PROBA0 = {("preds0" if k == "preds" else k): v for k, v in _PROBA.items()}
_EVALUATE = {"preds": _EVALUATE["preds"]} | {k: v for k, v in _EVALUATE.items() if k != "preds"}


@query("evaluate", with_ctes(["complaints", "proba_wide"], "select run, metric, round(value, 6) as value from metrics", _PROBA0 | _EVALUATE))
def _(spark, sf_dir):
    metrics = evaluation.evaluate(predictions(spark, sf_dir), CLASSES)
    return rounded(metrics.select(F.concat_ws(":", "model", "split").alias("run"), "metric", "value"), "value")


_HEADLINES = ["accuracy", "macro_f1", "weighted_f1", "log_loss"]


@query("compare_runs", with_ctes(["complaints", "proba_wide"],
    "select run, " + ", ".join(f"round(max(value) filter (metric = '{m}'), 6) as {m}" for m in _HEADLINES)
    + " from metrics group by run", _PROBA0 | _EVALUATE))
def _(spark, sf_dir):
    metrics = evaluation.evaluate(predictions(spark, sf_dir), CLASSES)
    runs = metrics.select(F.concat_ws(":", "model", "split").alias("run"), "metric", "value")
    return rounded(evaluation.compare_runs(runs, _HEADLINES), *_HEADLINES)


@query("write_report", with_ctes(["complaints", "proba_wide"], "select run, metric, round(value, 6) as value from metrics", _PROBA0 | _EVALUATE))
def _(spark, sf_dir):
    metrics = evaluation.evaluate(predictions(spark, sf_dir), CLASSES)
    runs = metrics.select(F.concat_ws(":", "model", "split").alias("run"), "metric", "value")
    path = files.write_report(runs, work_path(spark, "metrics"))
    return rounded(spark.read.schema(runs.schema).json(path), "value")


# Explanation.

@query("top_features_per_class", with_ctes(["complaints"], """
    select class, string_agg(term, ', ' order by r) as top_features from (
        select *, row_number() over (partition by class order by round(w, 9) desc, term) as r from coef) where r <= 15 group by class""", WORD_MODEL))
def _(spark, sf_dir):
    model = fixed_model(_complaints(spark, sf_dir))
    weights = F.transform("weights", lambda w: F.round(w, 9))
    stable = linear.LinearModel(model.classes, model.intercepts, model.terms.withColumn("weights", weights), model.blocks)
    return explanation.top_features_per_class(stable)


_EXPLAIN = WORD_MODEL | {
    "ranked": "select *, row_number() over (partition by complaint_id order by round(p, 9) desc, class) as r from proba",
    "contrib": """select v.complaint_id, v.term, round(v.value * f.w, 9) as c from vals v
        join ranked k on k.complaint_id = v.complaint_id and k.r = 1
        join coef f on f.class = k.class and f.block = v.block and f.term = v.term""",
    "reasons": """select *, row_number() over (partition by complaint_id order by c desc, term) as up,
        row_number() over (partition by complaint_id order by c, term) as down from contrib where c <> 0""",
    "told": """select complaint_id, string_agg(term, ';' order by up) filter (up <= 10) as pushed_for,
        string_agg(term, ';' order by down) filter (down <= 10 and c < 0) as pushed_against from reasons group by complaint_id""",
    "explained": """select a.complaint_id, a.class as pred, round(a.p, 6) as confidence, b.class as runner_up,
        coalesce(t.pushed_for, '') as pushed_for, coalesce(t.pushed_against, '') as pushed_against
        from ranked a join ranked b on b.complaint_id = a.complaint_id and b.r = 2
        left join told t on t.complaint_id = a.complaint_id where a.r = 1""",
}


def _told(df: DataFrame) -> DataFrame:
    def names(c: str):
        return F.coalesce(F.array_join(F.col(c)["feature"], ";"), F.lit("")).alias(c)

    return df.select("complaint_id", "pred", F.round("confidence", 6).alias("confidence"), "runner_up",
                     names("pushed_for"), names("pushed_against"))


@query("explain_rows", with_ctes(["complaints"], "select * from explained", _EXPLAIN))
def _(spark, sf_dir):
    df = _complaints(spark, sf_dir)
    return _told(explanation.explain_rows(df, fixed_model(df)))


@query("example_rows", with_ctes(["complaints", "proba_wide"], """
    select * from explained where complaint_id in (
        (select complaint_id from preds where correct order by md5('0|' || complaint_id::varchar), complaint_id limit 5)
        union all (select complaint_id from preds where not correct order by confidence desc, complaint_id limit 5))""",
    {k: v for k, v in _EXPLAIN.items()} | {("fixed_long" if k == "long" else k): v.replace("from long)", "from fixed_long)")
        .replace("join long l", "join fixed_long l") for k, v in _PROBA.items()}))
def _(spark, sf_dir):
    df = _complaints(spark, sf_dir)
    return _told(explanation.example_rows(predictions(spark, sf_dir), fixed_model(df)))


# Slices.

_SLICE = """select key, count(*) as n, avg(correct::int) as accuracy from sliced where key is not null group by key"""


def _slice_sql(key: str, name: str, sliced: str, order: str = "") -> str:
    return preds_sql(f"""
        select s.key as {name}, s.n, round(s.accuracy, 6) as accuracy, round(m.macro_f1, 6) as macro_f1
        from scores s join macro m using (key)""", {
        "sliced": sliced,
        "scores": _SLICE,
        "sides": """select key, product as class from sliced where key is not null
                    union select key, pred from sliced where key is not null""",
        "slice_f1": """select c.key, c.class, 2.0::double * count(*) filter (s.product = c.class and s.pred = c.class)
            / (count(*) filter (s.product = c.class) + count(*) filter (s.pred = c.class)) as f1
            from sides c join sliced s on s.key = c.key and (s.product = c.class or s.pred = c.class) group by all""",
        "macro": "select key, avg(f1) as macro_f1 from slice_f1 group by key",
    })


def _with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explanation.join_slice_attributes(predictions(spark, sf_dir), _complaints(spark, sf_dir))


@query("join_slice_attributes", preds_sql("select complaint_id, pred, correct, narrative_len, submitted_via from preds"))
def _(spark, sf_dir):
    return _with_attributes(spark, sf_dir).select("complaint_id", "pred", "correct", "narrative_len", "submitted_via")


@query("slice_by_length", _slice_sql("length", "length_bucket", """
    select *, case when narrative_len <= 0 then null when narrative_len <= 200 then '<200' when narrative_len <= 500 then '200-500'
      when narrative_len <= 1000 then '500-1k' when narrative_len <= 2000 then '1k-2k' when narrative_len <= 5000 then '2k-5k'
      when narrative_len <= 10000000 then '>5k' end as key from preds"""))
def _(spark, sf_dir):
    return rounded(explanation.slice_by_length(_with_attributes(spark, sf_dir)), "accuracy", "macro_f1")


@query("slice_by_company", _slice_sql("company", "company", """
    select *, company as key from preds where company in (
        select company from preds group by company order by count(*) desc, company limit 10)"""))
def _(spark, sf_dir):
    return rounded(explanation.slice_by_company(predictions(spark, sf_dir)), "accuracy", "macro_f1")


@query("slice_by_channel", _slice_sql("channel", "submitted_via", """
    select *, submitted_via as key from preds union all select *, '(all)' as key from preds"""))
def _(spark, sf_dir):
    return rounded(explanation.slice_by_channel(_with_attributes(spark, sf_dir)), "accuracy", "macro_f1")
