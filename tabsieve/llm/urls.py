"""URL filters with redirect equivalence.

A rule is a host and a path prefix with a verdict; it fits the host and all its subdomains, and the
longest fitting rule decides.  URLs that lead to one page share a verdict: canonical links and refresh
redirects of the pages, further redirects that the caller knows, and the usual canonical form of a URL
are edges of a graph, and a block decision reaches every URL of its connected component that has no
rule of its own, unless some URL of the component is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.common import BROADCAST_ROWS, looked_up, materialise
from tabsieve.llm.components import connected_components

#: a URL or component with more than one part in so many of all rows is looked up by broadcast
HEAVY = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: query parameters that say where a visitor came from, not what the page is
_TRACKING = r"(?<=[?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&#]*&?"
#: host names of the same site for other clients
_MIRROR = r"^(www|m|amp)\."


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The form a URL usually redirects to, without scheme: mirror host names, fragment, tracking parameters and
    a closing slash are left out.  NULL for a URL without host."""
    query = F.regexp_replace(F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1), _TRACKING, "")
    host = F.regexp_replace(host_of(url), _MIRROR, "")
    form = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.regexp_replace(query, "[?&]$", ""))
    return F.when(host != "", form)


def _resolved(link: Column, url: Column) -> Column:
    """A link of the page at ``url`` as a URL: absolute, of the page's scheme (``//``), from its root (``/``), of its path (``?``) or from
    its folder, with ``.`` and ``..`` resolved.  NULL for what names no other page (empty, a fragment, ``mailto:`` and the like)."""
    root = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([^:/?#]*:)//", 1)
    folder = F.regexp_extract(path_of(url), r"^(.*)/[^/]*$", 1)
    path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    steps = F.split(F.concat(F.when(path.startswith("/"), F.lit("")).otherwise(folder), F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/")), path), "/")
    kept = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), lambda acc, x:
                       F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    folder_named = F.when(path.rlike(r"(^|/)\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    relative = F.concat(root, F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, folder_named).otherwise(F.lit("")), rest)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link))
            .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(link.startswith("?"), F.concat(root, path_of(url), link)).otherwise(relative))


def page_links(html: Column, url: Column) -> Column:
    """Targets a page names for itself, in order: all canonical links and refresh redirects, attributes in any order."""
    canonical_tag = r"""(?i)\srel\s*=\s*["']?\s*canonical\b"""
    refresh_tag = r"""(?i)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<link\s[^>]*>)"), 1), lambda t: t.rlike(canonical_tag))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<meta\s[^>]*>)"), 1), lambda t: t.rlike(refresh_tag))
    found = F.concat(F.transform(links, lambda t: F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']?\s*([^"'\s>]+)""", 1)),
                     F.transform(metas, lambda t: F.regexp_extract(t, r"""(?i)[\s;"']url\s*=\s*["']?\s*([^"'\s>]+)""", 1)))
    whole = F.transform(found, lambda x: _resolved(x, url))
    return F.when(F.instr(url, F.lit("://")) > 0, F.array_compact(whole)).otherwise(F.array().cast("array<string>"))


def _size_checked(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.count() <= BROADCAST_ROWS else rules


def judge(df: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str | None = None,
          redirects: DataFrame | None = None, form: Callable[[Column], Column] | None = canonical) -> DataFrame:
    """Verdicts of the distinct URLs of ``df``: ``url, host, path, rule, own, verdict, pages``.

    ``rules`` has ``host``, ``path`` (starting with ``/``) and ``verdict`` (allow or block); ``own`` is the longest
    fitting rule's verdict or NULL, ``verdict`` that or the component's, ``allow`` where neither blocks.
    ``redirects`` has ``src`` and ``dst`` URLs; rows with a null end count for nothing.  URLs of one ``form`` are aliases: the
    default leaves out what is usually no part of a page's name, which is a guess; None lets only links and redirects count.
    NULL is one of the distinct URLs: like a URL without ``://`` it has an empty host and path, fits no rule and has no
    alias.  Rules of equal length (only possible as repeats) prefer allow.  ``pages`` counts the rows of ``df`` with the URL.  Many pages
    of one URL, and many URLs of one host, are judged once; no group of either is gathered."""
    pages = df.select(F.col(f"`{url_col}`").alias("url"), *([F.col(f"`{html_col}`").alias("html")] if html_col else []))
    links = [pages.select(F.col("url").alias("src"), F.explode(page_links(F.col("html"), F.col("url"))).alias("dst"))] if html_col else []
    links += [redirects.select("src", "dst")] if redirects is not None else []
    urls = pages.select("url", F.lit(1).alias("n"))
    for edge in links:
        for end in ("src", "dst"):
            urls = urls.unionByName(edge.select(F.col(end).alias("url"), F.lit(0).alias("n")))
    urls = urls.groupBy("url").agg(F.sum("n").alias("pages"))
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "pages")

    # a URL meets the rules of its host and of every parent domain; one best rule per URL comes back
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)),
                          lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    ruled = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("own"),
                         F.concat("host", "path").alias("rule"))
    best = (urls.where("host <> ''").select("url", "path", F.explode(parents).alias("rule_host"))
            .join(_size_checked(ruled), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
            .groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), F.when(F.col("own") == "allow", 1).otherwise(0),
                                               "rule", "own")).alias("best"))
            .select("url", "best.rule", "best.own"))
    judged = urls.join(best, "url", "left").withColumn("node", F.md5("url")).checkpoint()

    known = judged.where("url is not null")
    edges = judged.limit(0).select(F.col("node").alias("src"), F.col("node").alias("dst"))
    if form is not None:
        edges = edges.unionByName(known.select(F.col("node").alias("src"), F.md5(form(F.col("url"))).alias("dst")))
    for edge in links:
        edges = edges.unionByName(edge.select(F.md5("src").alias("src"), F.md5("dst").alias("dst")))
    parts = connected_components(edges).withColumnRenamed("component", "part")
    placed = known.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")).checkpoint()
    # a decision travels through a component as one row; the rows of a large component stay where they are
    groups = placed.groupBy("part").agg(F.max(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allowed"),
                                        F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"), F.count(F.lit(1)).alias("size"))
    reached = groups.where("blocked AND NOT allowed").select("part", "size", F.lit("block").alias("inherited"))
    told = looked_up(placed, "part", reached, F.col("size") * HEAVY > known.count(), "left")
    columns = ["url", "host", "path", "rule", "own", F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"), "pages"]
    nameless = judged.where("url is null").withColumn("inherited", F.lit(None).cast("string"))
    return told.select(*columns).unionByName(nameless.select(*columns))


def filter_urls(df: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url", html_col: str | None = None,
                redirects: DataFrame | None = None, form: Callable[[Column], Column] | None = canonical) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row of ``df`` (see ``judge``); repeated rows come back as often."""
    judged = materialise(judge(df, rules, url_col, html_col, redirects, form), "url-verdicts")
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`").alias("url"))
    total = judged.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    columns = [F.col(f"`{id_col}`"), "host", "path", "rule", "verdict"]
    found = looked_up(rows.where("url IS NOT NULL"), "url", judged.where("url IS NOT NULL").drop("own"), F.col("pages") * HEAVY > total)
    nameless = rows.where("url IS NULL").select(F.col(f"`{id_col}`"), F.lit("").alias("host"), F.lit("").alias("path"),
                                                F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return found.select(*columns).unionByName(nameless)
