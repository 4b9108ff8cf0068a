"""URL rules, and block decisions carried along redirects and canonical links.

A rule is a host and the beginning of a path; it holds for its host and all
subdomains, and the longest rule that fits decides. A page that no rule fits
is judged with its equivalents: URLs joined by redirect and canonical-link
edges form components, and a component with a blocked URL blocks its members,
unless one of its URLs is explicitly allowed; an explicit allow comes first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, cut
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)\A.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_CANONICAL = r"(?is)<link\b[^>]*\srel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical\b)[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parse_rules(text: str) -> list[Rule]:
    """Rules as ``verdict host/path``, one a line or separated by commas."""
    rules = []
    for line in text.replace(",", "\n").split("\n"):
        if line.strip():
            verdict, where = line.split()
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict}")
            host, slash, path = where.partition("/")
            rules.append(Rule(verdict, host, slash + path))
    return rules


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return _ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER, 2)


def vertex_of(url: Column) -> Column:
    """A URL without scheme and fragment, its host in lower case and an empty path as ``/``; null where there is no host."""
    host, path = host_of(url), path_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, _AFTER, 3)))


def _match(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Linear in the rules, in the row."""
    if not rules:
        return F.lit(None).cast("struct<host:string,path:string,verdict:string>")
    by_length = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host), r))
    table = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in by_length])
    return F.get(F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])), F.lit(0))


def _without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments, as a browser resolves them."""
    none = F.array().cast("array<string>")

    def step(kept: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\A/", ""), r"(\A|/)(\.\.?)\z", "$1$2/"), "/")
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(F.aggregate(parts, none, step), "/"))).otherwise(path)


def _target(base: Column, link: Column) -> Column:
    """The vertex a link leads to, resolved against its page's URL; null for links to the page itself, without a host, or of schemes without one."""
    host, at = host_of(base), path_of(base)
    clean = F.regexp_replace(F.regexp_replace(link, "(?i)&(?:amp|#38|#x26);", "&"), "(?s)#.*", "")
    path, query = F.regexp_extract(clean, r"(?s)\A([^?]*)", 1), F.regexp_extract(clean, r"(?s)\A[^?]*(.*)", 1)
    folder = F.regexp_replace(F.when(at == "", "/").otherwise(at), r"[^/]*\z", "")
    return (
        F.when(clean.rlike(r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://"), vertex_of(clean))
        .when(F.startswith(clean, F.lit("//")), vertex_of(F.concat(F.lit("x:"), clean)))
        .when(clean.rlike(r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*:") | (clean == "") | (host == ""), F.lit(None).cast("string"))
        .when(path == "", F.concat(host, F.when(at == "", "/").otherwise(at), query))
        .when(F.startswith(path, F.lit("/")), F.concat(host, _without_dots(path), query))
        .otherwise(F.concat(host, _without_dots(F.concat(folder, path)), query))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): all canonical links and refreshes of the pages' own markup."""
    html, url = F.col(html_col), F.col(url_col)
    none = F.array().cast("array<string>")

    def links(hint: str, tag: str, where: str) -> Column:
        return F.when(html.rlike(hint), F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, where, 1))).otherwise(none)

    both = F.concat(links("(?i)canonical", _CANONICAL, _HREF), links("(?i)http-equiv", _REFRESH, _REFRESH_URL))
    found = pages.select(url.alias("url"), F.explode(F.filter(both, lambda x: x.isNotNull() & (x != ""))).alias("link"))
    return found.select(vertex_of(F.col("url")).alias("u"), _target(F.col("url"), F.col("link")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")


def judge_pages(
    pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row: its id, host, path, rule, verdict, component.

    *redirects* may hold more edges as (source, target) URLs. host and path are
    empty for a null url or one without ``://``. rule is null where none fits;
    the verdict is then that of the component, or allow. component is the least
    URL joined to this one, null where it has no edges. Rows are judged each,
    repeated ids and URLs alike; an empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    edges = page_edges(pages.select(url.alias(url_col), F.col(html_col).cast("string").alias(html_col)), url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(vertex_of(F.col("source")).alias("u"), vertex_of(F.col("target")).alias("v")))
    joined = cut(components(edges))
    as_url = F.concat(F.lit("x://"), F.col("vertex"))
    told = joined.withColumn("m", bind(F.struct(host_of(as_url).alias("h"), path_of(as_url).alias("p")), lambda s: _match(s["h"], s["p"], rules))["verdict"])
    verdicts = told.groupBy("component").agg(F.when(F.max((F.col("m") == "allow").cast("int")) == 1, "allow").when(F.max((F.col("m") == "block").cast("int")) == 1, "block").alias("carried"))
    carried = joined.join(verdicts, "component").select("vertex", "component", "carried")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), vertex_of(url).alias("__v"))
    rows = rows.withColumn("m", _match(F.col("host"), F.col("path"), rules)).join(carried, F.col("__v") == F.col("vertex"), "left")
    return rows.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.concat("m.host", "m.path").alias("rule"),
        F.coalesce("m.verdict", "carried", F.lit("allow")).alias("verdict"),
        "component",
    )
