import pytest
from pyspark.sql import functions as F

from textroute.llm import url_filter as uf

PAGES = "page_id long, url string, html string, host string, rule string"


def judged(spark, rows, rules=uf.RULES, redirects=None):
    pages = spark.createDataFrame([(*r, "other", "other") for r in rows], PAGES)
    moved = spark.createDataFrame(redirects, "source string, target string") if redirects is not None else None
    out = uf.judge_urls(pages, uf.rule_table(spark, rules), moved)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def canonical(url):
    return f"<html><head><LINK href='{url}' rel=canonical></head>"


def test_rules_hosts_and_paths(spark):
    urls = ["http://a.example.net/en/x", "http://EXAMPLE.net/de/x?p=://y", "http://notexample.net/", "http://b.net", "https://x.example.com/de/#f",
            "http://example.com/den", "http://w.org/fr/", "http://org/fr/a", "plain", None, "", "http://É.NET/", "http://u:p@h.net:80/x"]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)])
    want = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/x", "net/", "block"),
            ("notexample.net", "/", "net/", "block"), ("b.net", "", None, "allow"), ("x.example.com", "/de/", "example.com/de/", "block"),
            ("example.com", "/den", None, "allow"), ("w.org", "/fr/", "org/fr/", "allow"), ("org", "/fr/a", "org/fr/", "allow"),
            ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("É.net", "/", "net/", "block"),
            ("u:p@h.net:80", "/x", None, "allow")]
    assert got == sorted([(i, *w) for i, w in enumerate(want)], key=str)


def test_blocks_pass_over_canonical_links_and_redirects(spark):
    rows = [(1, "http://x.com/1", canonical("http://bad.net/a")),                        # alias of a blocked address
            (2, "http://x.com/2#top", "<meta http-equiv=\"Refresh\" content=\"0; url=/1\">"),  # redirect to an alias
            (3, "http://free.org/fr/3", canonical("http://x.com/1")),                    # its own rule allows, and so the component
            (4, "HTTP://Y.com/4", canonical("//bad.net/b?x=1&amp;y=2")), (5, "http://y.com/sub/5", canonical("../4")),
            (6, "http://z.com/6", canonical("mailto:x")), (7, "http://z.com/dir/7", canonical("8")), (8, "http://z.com/dir/8", ""),
            (9, "http://q.com/9", None), (9, "http://q.com/9", None)]
    got = {r[0]: r[4] for r in judged(spark, rows)}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
    without = {r[0]: r[4] for r in judged(spark, [r for r in rows if r[0] != 3])}
    assert without[1] == without[2] == "block"
    assert len(judged(spark, rows)) == len(rows)
    moved = {r[0]: r[4] for r in judged(spark, rows, redirects=[("http://q.com/9", "http://z.com/dir/8"), ("http://z.com/dir/8", "http://w.net/"), (None, "http://w.net/")])}
    assert moved[9] == moved[8] == moved[7] == "block"


def test_a_link_without_use_hides_no_other(spark):
    def page(*links):
        return "".join(f"<link rel='canonical' href='{u}'>" for u in links)
    rows = [(1, "http://x.com/1", page("", "#top", "mailto:a@b.c", "http://bad.net/a")),
            (2, "http://x.com/2", "<meta http-equiv=refresh content='0; url=#a'><META http-equiv=refresh content='0; URL=http://bad.net/b'>"),
            (3, "http://x.com/3", page("http://x.com/3", "4", "5")), (4, "http://x.com/4", None), (5, "http://x.com/5", page("http://w.net/")),
            (6, "http://y.com/6", page("#a", "mailto:x"))]
    assert {r[0]: r[4] for r in judged(spark, rows)} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


@pytest.mark.parametrize("base, link, want", [
    ("http://a.b/c/d?q#f", "e", "http://a.b/c/e"), ("http://a.b/c/d?q#f", "/e#x", "http://a.b/e"), ("http://a.b", "e", "http://a.b/e"),
    ("HTTPS://A.B/x", "//C.d/Y", "https://c.d/Y"), ("http://a.b/c?x", "?y", "http://a.b/c?y"), ("http://a.b/c", "#y", None),
    ("http://a.b/c", "", None), ("http://a.b/c", "data:x", None), ("a.b", "http://c.d/", None), (None, "http://c.d/", None)])
def test_links_resolve(spark, base, link, want):
    row = spark.createDataFrame([(base, link)], "b string, l string").select(uf.resolve(F.col("l"), F.col("b")).alias("r")).first()
    assert row.r == want


def test_a_hub_of_aliases(spark):
    rows = [(i, f"http://x.com/{i}", canonical("http://hub.com/")) for i in range(300)] + [(999, "http://hub.com/", canonical("http://w.net/"))]
    assert {r[4] for r in judged(spark, rows)} == {"block"}


def test_empty_table(spark):
    assert judged(spark, []) == []


def test_sql_agrees_where_pages_have_links(spark, tmp_path):
    import duckdb

    from tests.oracle_check import differences
    rows = [(i, f"http://s{i % 7}.x.com/{i}", canonical(f"/{i + 7}") if i % 3 else canonical(f"http://s{i % 5}.{'net' if i % 4 else 'org'}/fr/{i}"))
            for i in range(60)] + [(70, "HTTP://Y.com", "<meta content='1;URL=q?a=1&amp;b' http-equiv=refresh>"), (71, None, "<link rel=canonical href=x>"),
            (72, "http://x.com/72", "<link rel=canonical href='#'><link href=mailto:a rel=canonical><link rel=canonical href='http://bad.net/'>"),
            (73, "http://x.com/73", "<meta http-equiv=refresh content='0'><meta http-equiv=refresh content='0;url=72'><link rel=canonical href=74>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    out = uf.op2(spark, str(tmp_path))
    assert differences(out, con, uf.ORACLE) == []
    assert out.filter("rule is null and verdict = 'block'").count() > 5
