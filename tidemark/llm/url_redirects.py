"""Operator 4 [native]: URL filters with redirect equivalence.

Rules (host, path prefix, verdict) fit a host and its subdomains; the longest rule wins. URLs that redirect to one another
or name one another as canonical are aliases: connected components over these links carry decisions. A page that a rule
fits keeps that rule's verdict. Any other page follows its aliases: an explicit allow among them takes precedence over an
explicit block; without either it is allowed.

Targets of links are judged by the rules as pages are.

Links come from a table of redirects, if given, from canonical links and meta refreshes in the html (relative to the
page's url), and from the canonical form that a URL implies: no scheme, `www.` or `m.`, fragment, tracking parameter, `.html` or closing slash.

Nulls: a null url, or one without `://`, has empty host and path, no rule and no aliases, and is allowed; a null page_id
is kept. Repeated rows stay; other columns are ignored, whatever their names; an empty table gives an empty result. Rules of
one length that both fit: the later in order of (host, path, verdict). Very long urls and html are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, saved, table

#: Rules as (host, path prefix, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The rule that fits and is longest, as struct (rule, verdict); null if none fits. Rules are few, and literals of the plan."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def canonical(url: Column) -> Column:
    """The form that a URL's variants share; null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"(?:\.html?|/index\.html?)$", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(r"^(?:utm_\w+|ref|fbclid|gclid)=")), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def resolved(link: Column, base: Column) -> Column:
    """The URL that a link in the page at `base` names; null for other schemes, and for relative links without a base."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base)), r"(?s)^(.*/)", 1)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    way, tail = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    full = F.regexp_replace(F.when(way.startswith("/"), way).otherwise(F.concat(folder, way)), r"^/", "")
    closed = F.regexp_replace(full, r"(^|/)(\.\.?)$", "$1$2/")
    path = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(closed, "/"), F.array().cast("array<string>"), step), "/"))
    scheme = F.coalesce(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.lit(""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.when(scheme == "", F.lit("http:")).otherwise(scheme), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host_of(base) == ""), F.lit(None).cast("string"))
        .when(way == "", F.concat(origin, path_of(base), tail))
        .otherwise(F.concat(origin, path, tail))
    )


def html_links(html: Column, base: Column) -> Column:
    """URLs that the page at `base` names as its canonical address or refreshes to."""
    tag = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    link = lambda x: F.when(x.rlike(r"(?i)rel\s*=\s*[\"']?canonical\b"), F.regexp_extract(x, r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", 1)).otherwise(F.when(x.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"), F.regexp_extract(x, r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1)))
    return F.filter(F.transform(F.filter(F.transform(tag, link), lambda x: x != ""), lambda x: resolved(F.regexp_replace(x, "&amp;", "&"), base)), lambda x: x.isNotNull())


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html). redirects: (src, dst) of URLs.

    Nodes are 64-bit hashes of canonical forms, so a URL's own variants meet without an edge; edges are only those
    between different forms. No group is gathered: decisions of a component are a map-side minimum. Rows without a form
    are spread over nodes by page_id, so that many of them make no hot key; they take nothing from there.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("form", canonical(F.col("url")))
    thin = rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("own"), F.when(F.col("form").isNull(), F.xxhash64("page_id", F.lit("alone"))).otherwise(F.xxhash64("form")).alias("node"), F.col("form").isNull().alias("alone"), F.filter(F.transform(html_links(F.col("html"), F.col("url")), lambda u: F.struct(F.when(canonical(u).isNotNull(), F.xxhash64(canonical(u))).alias("node"), rule_of(host_of(u), path_of(u), rules)["verdict"].alias("own"))), lambda t: t["node"].isNotNull()).alias("to"))
    thin = saved(thin, "urls")
    edges = thin.where("not alone and size(to) > 0").select(F.col("node").alias("src"), F.explode_outer("to.node").alias("dst"))
    if redirects is not None:
        edges = edges.union(redirects.where(canonical(F.col("src")).isNotNull() & canonical(F.col("dst")).isNotNull()).select(F.xxhash64(canonical(F.col("src"))).alias("src"), F.xxhash64(canonical(F.col("dst"))).alias("dst")))
        moved = redirects.select(F.explode(F.array("src", "dst")).alias("u")).where(canonical(F.col("u")).isNotNull())
        ruled = moved.select(F.xxhash64(canonical(F.col("u"))).alias("node"), rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("own"))
    else:
        ruled = None
    linked = components(edges)
    said = thin.where("not alone and own is not null").select("node", "own").distinct()
    named = thin.where("not alone and size(to) > 0").select(F.explode_outer("to").alias("t")).select("t.node", "t.own")
    said = said.union(named.where("own is not null")).distinct()
    said = said if ruled is None else said.union(ruled.where("own is not null")).distinct()
    of = lambda df: df.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by = of(said).groupBy("component").agg(F.min("own").alias("alias"))  # 'allow' < 'block'
    found = of(thin).join(by, "component", "left")
    verdict = F.coalesce("own", F.when(~F.col("alone"), F.col("alias")), F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op4_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


#: For pages without canonical links or refreshes in their html: there, aliases are the pages of one canonical form.
SQL = r"""
with a as (select page_id, coalesce(url, '') as url from pages),
b as (select page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1) as query from a),
c as (select *, case
  when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
  when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule,
  case when host <> '' then regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '(?:\.html?|/index\.html?)$', '')
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(?:utm_\w+|ref|fbclid|gclid)=')), '&'), ''), '') end as form from b),
d as (select *, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as own from c)
select page_id, host, path, rule, coalesce(own, case when form is not null then min(own) over (partition by form) end, 'allow') as verdict from d"""
