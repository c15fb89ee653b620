import numpy as np
import pytest
from pyspark.sql import functions as F

from textroute.llm import language_id as li
from textroute.llm.letters import folded

DOCS = "doc_id long, text string, lang string, language string"
WORDS = {"en": "the of and was with thing from water", "de": "der die und nicht schön wasser über zeit", "nl": "het een van niet water wij zijn ook",
         "fr": "le les des était avec où français eau", "es": "el los está con agua niño más donde", "xx": "zug bukk zog dubb kuzz"}


def text(lang, i):
    words = WORDS[lang].split()
    return " ".join(words[(i * 7 + j * j) % len(words)] for j in range(4 + i % 9))


def table(spark, n=30):
    rows = [(k * 1000 + i, text(lang, i), lang, "x") for k, lang in enumerate(WORDS) for i in range(n)]
    rows += [(90000, None, "en", ""), (90001, "", "en", ""), (90002, "12 34 !?", "fr", ""), (90003, text("de", 3) * 3000, None, ""),
             (None, text("fr", 4), None, ""), (None, text("fr", 4), None, "")]
    return spark.createDataFrame(rows, DOCS)


def test_languages_and_odd_rows(spark):
    docs = table(spark)
    got = li.identify(docs, li.train(docs)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[k * 1000 + i] for k in range(len(WORDS)) for i in range(30)] == [lang for lang in WORDS for _ in range(30)]
    assert by_id[90000] == by_id[90001] == by_id[90002] == "und" and by_id[90003] == "de" and by_id[None] == "fr"


def test_languages_of_held_out_rows_are_not_read(spark):
    docs = table(spark)
    learn = ~li.held_out(F.col("id"), 4, 2)
    turned = docs.withColumn("lang", F.when(li.held_out(F.col("doc_id"), 4, 2), F.lit("zz")).otherwise(F.col("lang")))
    a, b = li.train(docs, learn), li.train(turned.repartition(5), learn)
    assert a.languages == b.languages and np.allclose(a.families, b.families) and all(np.allclose(w, b.pairs[p]) for p, w in a.pairs.items())


def test_rows_without_letters_are_dropped(spark):
    kept = li.drop_unknown(table(spark))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert kept.filter("doc_id >= 90000").count() == 1 and kept.filter("doc_id is null").count() == 2


@pytest.mark.parametrize("langs, want", [([], "und"), (["en"], "en")])
def test_little_to_learn_from(spark, langs, want):
    docs = table(spark).withColumn("lang", F.when(F.col("lang").isin(langs), F.col("lang")))
    assert {r.lang_pred for r in li.identify(docs, li.train(docs)).filter("doc_id < 90000").collect()} == {want}


def test_families_and_folding():
    assert [li.family(x) for x in ("en", "pt-BR", "de_AT", "xx")] == ["germanic", "romance", "germanic", "xx"]
    assert folded("  Ab1,ÇÉ ").tobytes().decode("utf-32-le") == " ab çé " and len(folded(None)) == len(folded("12")) == 1
    a = li.Model((("aa", "bb"),), np.zeros((1, li.DIMS + 1)), {("aa", "bb"): np.zeros(li.DIMS + 1)})
    assert li.predict(li.vector("tie"), a) == ("aa", 0.5)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert li.identify(docs, li.train(docs)).count() == li.drop_unknown(docs).count() == 0


def test_query_is_right_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = li.op10(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
