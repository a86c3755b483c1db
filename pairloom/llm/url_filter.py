"""URL filters: host and path rules, and block decisions that follow redirects.

A url with a rule gets the rule's verdict. Urls without one take part in redirect
equivalence: canonical links, refresh redirects and urls that differ only in scheme,
fragment, tracking parameters or a last slash are edges; a connected component with a
blocked url blocks its aliases. An explicit allow takes precedence for the urls that its rule
fits, and for no other: it doesn't lift a block from aliases without a rule. Else a blocked site
could clear its aliases by a link to an allowed page, which anyone can set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import stage_table
from .components import connected_components

#: Query parameters that name no content (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the standard query (fixed values).
RULES = (
    UrlRule("org", "/", True),
    UrlRule("example.org", "/es/", False),
    UrlRule("example.org", "/en/1", False),
    UrlRule("com", "/fr/", True),
    UrlRule("com", "/de/", False),
)
#: Up to so many rules are one CASE expression; more are a table that is joined. Verdicts are the same.
CASE_RULES = 64
RULE_TABLE = "host string, path string, allow boolean"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """(rule, allow) of the longest rule that fits, or null; of equally long ones an allow rule, then by text."""
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.allow, r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


def _fitting_by_table(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with ``hit``, the same (rule, allow), for any number of rules.

    A host's suffixes meet the hosts of rules, with the lengths of their paths; then the url's prefixes of those lengths
    meet the rules themselves. Both are equal-key joins of distinct (host, path).
    """
    kept = rules.filter("host is not null and path is not null and allow is not null").groupBy("host", "path").agg(F.max("allow").alias("allow"))
    hosts = kept.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes")).withColumnRenamed("host", "suffix")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]', -1))), k -> substring_index(host, '.', -k))")
    urls = rows.select("host", "path").distinct()
    met = urls.withColumn("suffix", F.explode(F.array_distinct(suffixes))).join(hosts, "suffix").withColumn("size", F.explode("sizes")).filter(F.col("size") <= F.length("path"))
    known = kept.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "allow")
    found = met.withColumn("prefix", F.expr("left(path, size)")).join(known, ["suffix", "prefix"])
    best = F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "allow"), F.struct(F.length("suffix") + F.length("prefix"), "allow", "suffix", "prefix"))
    return rows.join(found.groupBy("host", "path").agg(best.alias("hit")), ["host", "path"], "left")


def alias_key(url: Column) -> Column:
    """One spelling for urls that differ in scheme, host case, fragment, tracking or last slash."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.substring_index(p, "=", 1).isin(*TRACKING) & (p != "")), "&")
    path = F.regexp_replace(path_of(bare), r"/+$", "")
    return F.concat(F.lit("//"), host_of(bare), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def resolved(base: Column, target: Column) -> Column:
    """``target`` of a link on the page ``base`` as an absolute url, or null if it has none."""
    page = F.regexp_replace(base, r"(?s)[?#].*$", "")
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.regexp_extract(target, r"(?s)[?#].*$", 0)
    steps = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path)), "/")
    up = lambda got: F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(1)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda got, x: F.when(x == "..", up(got)).when(x == ".", got).otherwise(F.concat(got, F.array(x))))
    joined = F.concat(origin, F.array_join(walked, "/"), rest)
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (origin == ""), None)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"^[?#]"), F.concat(page, target))
        .otherwise(joined)
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty without it."""
    groups = [F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", k) for k in (1, 2, 3)]
    return F.concat(*groups)


def unescaped(text: Column) -> Column:
    """``text`` with numeric entities, then the five named ones of XML, undone."""
    numeric = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1)))
    code = lambda x: F.when(x.rlike("^[xX]"), F.substring(x, 2, 6)).otherwise(F.conv(x, 10, 16))
    sign = lambda x: F.decode(F.unhex(F.lpad(code(x), 8, "0")), "UTF-32")
    out = F.aggregate(numeric, text, lambda got, x: F.replace(got, F.concat(F.lit("&#"), x, F.lit(";")), sign(x)))
    for name, char in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (u, v) between urls: canonical links and refresh redirects in the html, by alias key.

    Every link tag with ``canonical`` among the words of its rel, and every refresh, gives an edge; those in html
    comments give none. Entities in targets are undone. Relative targets are resolved against the page's url
    (a ``base`` tag isn't looked at); null urls and html, and targets of other schemes without ``://``, give none.
    """
    url = F.col(url_col)
    live = pages.filter(url.isNotNull() & F.col(html_col).isNotNull()).select(url.alias("url"), F.regexp_replace(html_col, r"(?s)<!--.*?-->", "").alias("html"))
    tags = lambda name: F.regexp_extract_all(F.col("html"), F.lit(rf"(?is)<{name}[\s/][^>]*>"), F.lit(0))
    canonical = F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(tags("meta"), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    target = lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s]+)", 1)
    found = F.concat(F.transform(canonical, lambda t: F.trim(_attribute(t, "href"))), F.transform(refresh, target))
    ends = live.select("url", F.explode(F.array_distinct(found)).alias("target")).withColumn("target", unescaped(F.col("target")))
    return ends.select(alias_key(F.col("url")).alias("u"), resolved(F.col("url"), F.col("target")).alias("v")).filter("v is not null").select("u", alias_key(F.col("v")).alias("v"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, blocked_by.

    ``rules`` may be a table of RULE_TABLE, of any size. ``redirects`` may add edges (src, dst) of urls. blocked_by: the root of the component
    that blocks a url without a rule, else null. Null urls, or urls without ``://``, have an
    empty host and path, no rule, and are allowed; repeated rows each get a row. Other columns
    of ``pages`` are not read.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.select("id", "host", "path", F.when(F.col("url").contains("://"), alias_key(F.col("url"))).alias("alias"))
    if isinstance(rules, DataFrame) or len(rules) > CASE_RULES:
        table = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame([(r.host, r.path, r.allow) for r in rules], RULE_TABLE)
        rows = _fitting_by_table(rows, table)
    else:
        rows = rows.withColumn("hit", _fitting(F.col("host"), F.col("path"), rules))
    rows = stage_table(rows.select("id", "host", "path", "hit.rule", "hit.allow", "alias"), "judged")
    links = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.filter("src is not null and dst is not null").select(alias_key(F.col("src")).alias("u"), alias_key(F.col("dst")).alias("v"))
        links = more if links is None else links.unionByName(more)
    # urls of one alias key are one node: its links are stars, so only keys need components
    bad = rows.filter("alias is not null and not allow").select("alias").distinct()
    blocked = bad.select("alias", F.col("alias").alias("blocked_by"))
    if links is not None:
        roots = connected_components(links)
        of = bad.join(roots, F.col("alias") == F.col("node"), "left").select("alias", F.coalesce("root", "alias").alias("blocked_by"))
        beside = roots.join(of.select(F.col("blocked_by").alias("root")).distinct(), "root").select(F.col("node").alias("alias"), F.col("root").alias("blocked_by"))
        blocked = of.unionByName(beside).distinct()
    verdict = F.when(F.coalesce(F.col("allow"), F.col("blocked_by").isNull()), "allow").otherwise("block")
    # rows with a rule, and rows without an alias, don't meet the blocked aliases
    free = F.col("rule").isNull() & F.col("alias").isNotNull()
    judged = rows.filter(free).join(blocked, "alias", "left").unionByName(rows.filter(~free).withColumn("blocked_by", F.lit(None).cast("string")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "blocked_by")
