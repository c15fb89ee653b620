from textroute.llm import license_scan as ls
from textroute.llm.license_texts import NOTICES, TEXTS

DOCS = "doc_id long, text string, license_id string, digest string"


def scanned(spark, rows, licenses=None):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    out = ls.scan(df, licenses if licenses is not None else ls.known_licenses(spark))
    assert out.columns == ["doc_id", "digest", "license_id", "notices", "notice_lines"]
    return out.collect()


def test_known_texts_are_found_however_they_are_written(spark):
    rows = [(i, t) for i, (_, t) in enumerate(TEXTS)]
    rows += [(100 + i, "Copyright (c) 2020 Some One\n  (C) Other, Inc.\n" + t.upper().replace(" ", "  \t").replace(",", " -- "))
             for i, (_, t) in enumerate(TEXTS)]
    rows += [(200 + i, t.replace("license", "licence").replace("License", "Licence").replace("holder", "owner").replace("http:", "https:"))
             for i, (_, t) in enumerate(TEXTS)]
    got = {r.doc_id: r.license_id for r in scanned(spark, rows)}
    assert got == {base + i: name for base in (0, 100, 200) for i, (name, _) in enumerate(TEXTS)}


def test_notices_on_their_own_line(spark):
    rows = [(1, "Some words.\nLICENSED UNDER THE MIT LICENCE\nmore\n * Licensed under CC-BY-4.0.\nreleased under the MIT License"),
            (2, "Licensed under the MIT License is not all of this line.\nmore"), (3, "Released under the ISC License."),
            (4, None), (4, ""), (5, "Copyright 1999 Me\nAll rights reserved."), (None, "x\nGNU"), (6, "x " * 100000 + "\nLicensed under CC0 1.0."),
            (1, "Some words.\nLICENSED UNDER THE MIT LICENCE\nmore\n * Licensed under CC-BY-4.0.\nreleased under the MIT License")]
    got = sorted(((r.doc_id, r.license_id, r.notices, r.notice_lines, r.digest is None) for r in scanned(spark, rows)), key=str)
    assert got == sorted([(1, None, "CC-BY-4.0;MIT", 3, False), (1, None, "CC-BY-4.0;MIT", 3, False), (2, None, "", 0, False),
                          (3, "ISC", "", 0, False), (4, None, "", 0, True), (4, None, "", 0, True), (5, None, "", 0, True),
                          (None, None, "", 0, False), (6, None, "CC0-1.0", 1, False)], key=str)


def test_own_licences_and_ties(spark):
    own = spark.createDataFrame([("b", "Ours only"), ("a", "OURS, only!"), ("c", None), ("d", " . ")], "license_id string, text string")
    assert [r.license_id for r in scanned(spark, [(1, "ours: only"), (2, "."), (3, "MIT License")], own)] == ["a", None, None]


def test_notices_have_one_meaning(spark):
    rows = ls.with_digest(ls.known_licenses(spark), "d").filter("d is not null")
    assert rows.groupBy("d").agg(ls.F.countDistinct("license_id").alias("n")).filter("n > 1").count() == 0
    assert len(NOTICES) > 100


def test_empty_table(spark):
    assert scanned(spark, []) == []
