"""URL filters with redirect equivalence (operator 3, DataFrame functions only).

A url is judged by the longest rule that fits its host (or a parent domain) and the start of its path. Pages
without a rule take part in their aliases' verdict: redirect and canonical-link edges join urls, connected
components over those edges are the aliases, and a component in which some url is blocked blocks its unruled
pages, unless some url of it is expressly allowed, which takes precedence. Anything else is allowed.

Edges come from a page's own markup (canonical links, refreshes) and from a table of redirects, if given.
Urls are nodes without scheme, fragment, default port, a host's capitals or final dot; an empty path is ``/``, and ``.`` and ``..``
are resolved. Relative links are resolved against the page. Host, path and rule columns stay as the url has them.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed. A
null html has no links. Repeated rows are judged alike. Of rules of equal length, allowing ones win. An empty
table gives an empty table. Columns of the result's names are replaced. Very long urls are nodes and are judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.graph import components
from strataform.llm.store import materialize

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The production rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """The node of a url: host, path and query in one form; null without ``://``."""
    secure = F.lower(F.substring_index(url, "://", 1)) == "https"
    host = F.regexp_replace(F.regexp_replace(host_of(url), F.when(secure, ":443$").otherwise(":80$"), F.lit("")), r"\.$", "")
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    names = F.filter(F.split(path_of(url), "/"), lambda s, i: i > 0)
    ended = F.when(path_of(url).rlike(r"(?s)/\.{0,2}$") & (F.size(names) > 1) & (F.element_at(names, -1) != ""), "/").otherwise("")  # a last . or .. is a folder
    kept = F.array_join(F.aggregate(names, F.array().cast("array<string>"), step), "/")
    path = F.concat(F.lit("/"), kept, F.when(kept == "", "").otherwise(ended))
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, query))


def judged(rows: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with the fitting rule's text and verdict, or nulls.

    A tuple of rules becomes an expression, a table (verdict, host, path) is joined: lists beyond some hundreds are a table.
    """
    if not isinstance(rules, DataFrame):
        best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):  # the last to fit wins
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            best, verdict = F.when(fits, F.lit(r.text)).otherwise(best), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
        return rows.withColumn("rule", best).withColumn("_ruled", verdict)
    table = rules.select(F.col("host").alias("domain"), F.col("path").alias("start"), F.col("verdict").alias("says"))
    # Distinct hosts and paths are judged, and meet the rules by each of their parent domains.
    places = rows.select("host", "path").distinct()
    parents = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    met = places.withColumn("domain", F.explode(parents)).join(table, "domain").filter(F.col("path").startswith(F.col("start")))
    text = F.concat("domain", "start")
    top = met.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), (F.col("says") == "allow").alias("allow"), text.alias("rule"), F.col("says").alias("_ruled"))).alias("top"))
    return rows.join(top.select("host", "path", "top.rule", "top._ruled"), ["host", "path"], "left")


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages and of what their canonical links and refreshes point to."""
    tags = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    rows = pages.filter(F.col("html").isNotNull() & key_of(F.col("url")).isNotNull()).select("url", tags.alias("tag"))
    value = lambda p: F.regexp_extract("tag", p, 1)
    canonical = F.when(F.col("tag").rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), value(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""))
    refresh = F.when(F.col("tag").rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""), value(r"""(?i)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""))
    to = rows.withColumn("to", F.coalesce(canonical, refresh)).filter("to <> ''").withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    base = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0)
    whole = (
        F.when(F.contains("to", F.lit("://")), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(base, "to"))
        .when(F.col("to").startswith("?") | F.col("to").startswith("#"), F.concat(base, path_of(F.col("url")), "to"))
        .otherwise(F.concat(base, F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path_of(F.col("url")), "^/", "")), "[^/]*$", ""), "to"))
    )
    return to.select(key_of(F.col("url")).alias("a"), key_of(whole).alias("b"))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``redirects``: (from_url, to_url)."""
    src = pages.select([c for c in pages.columns if c not in {"host", "path", "rule", "verdict", "_ruled", "_key", "_node", "_alias"}])
    ruled = judged(src.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), rules)
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(key_of(F.col("from_url")).alias("a"), key_of(F.col("to_url")).alias("b")))
    alias = materialize(components(edges), "aliases")
    # A node is judged by its own host and path, whether or not it is a page.
    scheme = F.concat(F.lit("http://"), "node")
    nodes = judged(alias.withColumn("host", host_of(scheme)).withColumn("path", path_of(scheme)), rules)
    said = nodes.groupBy("component").agg(F.count_if(F.col("_ruled") == "allow").alias("allowed"), F.count_if(F.col("_ruled") == "block").alias("blocked"))
    blocked = alias.join(said.filter("allowed = 0 AND blocked > 0").select("component"), "component").select(F.col("node").alias("_node"), F.lit("block").alias("_alias"))
    # Only pages without a rule, but with a node, can have an alias.
    keyed = ruled.withColumn("_key", F.when(F.col("_ruled").isNull(), key_of(F.col("url"))))
    out = keyed.filter(F.col("_key").isNotNull()).join(blocked, F.col("_key") == F.col("_node"), "left").drop("_node")
    out = out.unionByName(keyed.filter(F.col("_key").isNull()).withColumn("_alias", F.lit(None).cast("string")))
    return out.withColumn("verdict", F.coalesce("_ruled", "_alias", F.lit("allow"))).select(*src.columns, "host", "path", "rule", "verdict")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


#: The tables hold no links between pages, so that here a rule or the default decides; links are tested apart.
ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, html,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
