"""Block and allow rules for URLs, carried over redirects and canonical links.

A rule names a host and a path. Pages tell that they are aliases of another address by a canonical
link or an immediate redirect (`meta refresh`); crawlers may add redirects of their own. Addresses
that are connected that way form a component, found by distributed connected components, and a page
without a rule of its own takes the decision of its component.

Precedence: the longest rule that fits the page itself; else allow, if any address of the component
is explicitly allowed; else block, if any is blocked; else allow.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textroute.llm.components import connected_components
from textroute.llm.registry import query, table
from textroute.session import materialize

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

LINK = r"(?i)<link\b[^>]*>"
META = r"(?i)<meta\b[^>]*>"
CANONICAL = r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'>\s;]+)"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def url_host(url: Column) -> Column:
    """Host with any port and user, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), CAPITALS, SMALL), F.lit(""))


def url_path(url: Column) -> Column:
    """What stands between host and query or fragment."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The name a URL has in the alias graph: scheme and host in lower case, no fragment; null without `://`."""
    scheme = F.translate(F.substring_index(url, "://", 1), CAPITALS, SMALL)
    rest = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), url_host(url), rest))


def _site(scheme: Column, host: Column) -> Column:
    return F.concat(scheme, F.lit("://"), host)


def _folder(path: Column) -> Column:
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return F.when(folder == "", "/").otherwise(folder)


def _absolute(link: Column, scheme: Column, site: Column, path: Column, folder: Column) -> Column:
    """A trimmed link with the scheme and host it lacks; null for empty links, fragments and schemes without a host."""
    return (F.when(link.rlike(ABSOLUTE), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when((link == "") | link.startswith("#") | link.rlike(OTHER_SCHEME), F.lit(None))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link.startswith("?"), F.concat(site, path, link))
            .otherwise(F.concat(site, folder, link)))


def _plain(link: Column) -> Column:
    return F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))


def resolve(link: Column, base: Column) -> Column:
    """A link as an address, seen from `base`; null for empty links, fragments and schemes without a host."""
    scheme, path = F.substring_index(base, "://", 1), url_path(base)
    full = _absolute(_plain(link), scheme, _site(scheme, url_host(base)), path, _folder(path))
    return F.when(F.instr(base, "://") > 0, address(full))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`(source, target)` addresses from every canonical link and redirect inside pages.

    A link that doesn't resolve (empty, a fragment, `mailto:`) is no edge and hides no other. The parts of a page's
    own address are columns of an earlier step, so that `resolve`'s cases don't repeat them in the generated code.
    """
    def links(tags, mark, part):
        found = F.filter(F.regexp_extract_all(F.col("html"), F.lit(tags), 0), lambda t: t.rlike(mark))
        return F.transform(found, lambda t: F.regexp_extract(t, part, 1))
    rows = (pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
            .filter(F.col("html").rlike("(?i)canonical|refresh") & (F.instr("url", "://") > 0)))
    found = rows.select("url", F.explode(F.concat(links(LINK, CANONICAL, HREF), links(META, REFRESH, TARGET))).alias("link"))
    parts = found.select(_plain(F.col("link")).alias("link"), F.substring_index("url", "://", 1).alias("scheme"),
                         url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                         address(F.col("url")).alias("source"))
    sites = parts.withColumns({"site": _site(F.col("scheme"), F.col("host")), "folder": _folder(F.col("path"))})
    full = sites.select("source", _absolute(*map(F.col, ["link", "scheme", "site", "path", "folder"])).alias("full"))
    return full.select("source", address(F.col("full")).alias("target")).filter("source != target")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules `(verdict, "host/path")` as a table. A rule given twice with both verdicts allows."""
    rows = [(r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1] if "/" in r else "", r, v) for v, r in rules]
    table = spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, decision string")
    return table.groupBy("rule_host", "rule_path").agg(F.min("rule").alias("rule"), F.min("decision").alias("decision"))


def decide(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule for each distinct `(host, path)`: `(host, path, rule, decision)`, only where one fits."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = places.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("parent"))
    fits = spread.join(rules, F.col("parent") == F.col("rule_host")).filter(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule"), F.col("rule"), F.col("decision"))
    return fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.decision")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None,
               page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`(page_id, host, path, rule, verdict)` for every row of `pages`.

    `redirects` may hold further edges as `(source, target)` URLs. Null URLs and those without `://` have an empty
    host and path, no rule and no alias, and are allowed. A null page has no links. Repeated rows are judged as often
    as they come; rows keep their id whether it is null or repeated. Other columns are not read.
    """
    spark = pages.sparkSession
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source")).alias("source"), address(F.col("target")).alias("target")))
    roots = materialize(connected_components(edges, "source", "target"), "aliases")
    rules = materialize(rules, "rules")
    nodes = roots.select("node", "root", url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path"))
    ruled = nodes.join(decide(nodes, rules), ["host", "path"])
    groups = (ruled.groupBy("root").agg(F.min("decision").alias("of_aliases"))  # allow sorts before block
              .withColumnRenamed("root", "decided"))
    inherited = roots.join(groups, F.col("root") == F.col("decided")).select("node", "of_aliases")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), url_host(F.col(f"`{url}`")).alias("host"),
                        url_path(F.col(f"`{url}`")).alias("path"), address(F.col(f"`{url}`")).alias("address"))
    own = decide(rows, rules).select(F.col("host").alias("own_host"), F.col("path").alias("own_path"), "rule", "decision")
    return (rows.join(own, (F.col("host") == F.col("own_host")) & (F.col("path") == F.col("own_path")), "left")
            .join(materialize(inherited, "inherited"), F.col("address") == F.col("node"), "left")
            .select("page_id", "host", "path", "rule", F.coalesce("decision", "of_aliases", F.lit("allow")).alias("verdict")))


_HOST = "translate(regexp_extract({rest}, '^[^/?#]*', 0), '" + CAPITALS + "', '" + SMALL + "')"
_REST = "case when instr({u}, '://') > 0 then substr({u}, instr({u}, '://') + 3) else '' end"


def _host(u: str) -> str:
    return "coalesce(" + _HOST.format(rest=_REST.format(u=u)) + ", '')"


def _path(u: str) -> str:
    return "coalesce(regexp_extract(" + _REST.format(u=u) + ", '^[^/?#]*([^?#]*)', 1), '')"


def _address(u: str) -> str:
    scheme = f"translate(split_part({u}, '://', 1), '{CAPITALS}', '{SMALL}')"
    return (f"case when instr({u}, '://') > 0 then {scheme} || '://' || {_host(u)} || "
            f"regexp_extract({_REST.format(u=u)}, '^[^/?#]*([^#]*)', 1) end")


def _links(tags: str, mark: str, part: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return (f"list_transform(list_filter(regexp_extract_all(html, {q(tags)}), lambda t: regexp_matches(t, {q(mark)})), "
            f"lambda t: regexp_extract(t, {q(part)}, 1))")


_SITE = f"split_part(url, '://', 1) || '://' || {_host('url')}"
_FOLDER = f"regexp_replace({_path('url')}, '[^/]*$', '')"

ORACLE = f"""
with recursive rules(verdict, rule, rule_host, rule_path) as (
  values {', '.join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)}),
raw as (select url, replace(trim(l), '&amp;', '&') as link from (
  select url, unnest({_links(LINK, CANONICAL, HREF)} || {_links(META, REFRESH, TARGET)}) as l
  from pages where regexp_matches(html, '(?i)canonical|refresh'))),
full_links as (select url, case
    when regexp_matches(link, '{ABSOLUTE}') then link
    when starts_with(link, '//') then split_part(url, '://', 1) || ':' || link
    when link = '' or starts_with(link, '#') or regexp_matches(link, '{OTHER_SCHEME}') then null
    when starts_with(link, '/') then {_SITE} || link
    when starts_with(link, '?') then {_SITE} || {_path('url')} || link
    else {_SITE} || case when {_FOLDER} = '' then '/' else {_FOLDER} end || link end as target
  from raw where instr(url, '://') > 0),
edges as (select {_address('url')} as a, {_address('target')} as b from full_links),
ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach(node, other) as (select a, a from ways union select r.node, e.b from reach r join ways e on r.other = e.a),
places as (select {_host('url')} as host, {_path('url')} as path from pages
           union select {_host('other')}, {_path('other')} from reach),
own as (select host, path, max(struct_pack(len := length(rule), rule := rule, verdict := verdict)) as best
  from places join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path),
inherited as (select node, min(best.verdict) as verdict
  from reach join own on {_host('other')} = own.host and {_path('other')} = own.path group by node)
select p.page_id, p.host, p.path, own.best.rule as rule, coalesce(own.best.verdict, i.verdict, 'allow') as verdict
from (select page_id, {_host('url')} as host, {_path('url')} as path, {_address('url')} as address from pages) p
left join own on p.host = own.host and p.path = own.path left join inherited i on p.address = i.node
"""


@query("op2_redirect_aware_url_filter", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, fitting rule and verdict."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
