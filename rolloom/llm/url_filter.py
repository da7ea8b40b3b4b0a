"""URL rules whose block decisions follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.components import components
from rolloom.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Query parameters that don't change what a page shows.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")

#: Rules become one expression; more than this many are refused.
MOST_RULES = 2_000


class Rule(NamedTuple):
    """``action`` (allow or block) for a host with its subdomains and paths that start with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What stands between the first :// and the next / ? or #, with A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What stands between the host and the next ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (host and path together) that fits, as struct<rule, action>; else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "allow")):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        made = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.action).alias("action"))
        out = F.when(fits, made).otherwise(out)
    return out


def normal_form(url: Column) -> Column:
    """A spelling that urls of one page share: no scheme, port 80 or 443, fragment or tracking
    parameters, host in lower case, no index file or slash at the end. Null if there is no host."""
    where = F.regexp_replace(host(url), r":(?:80|443)$", "")
    stem = F.regexp_replace(path(url), r"(?:/index\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.when(where != "", F.concat(where, stem, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def _resolved(target: Column, base: Column) -> Column:
    """An absolute url for a link found on the page ``base``."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.substring_index(site, "//", 1), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when((target == "") | target.rlike("^[#?]|^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def declared_targets(html: Column, url: Column) -> Column:
    """Array of the absolute urls that a page's head names as itself: canonical link, refresh, og:url.

    Only <link> and <meta> tags before <body> count.
    """
    likely = html.rlike(r"(?i)canonical|http-equiv|og:url")
    head = F.substring_index(F.regexp_replace(html, r"(?i)<body", "<body"), "<body", 1)
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    value = r"""(?is)\s%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(tag: Column, name: str) -> Column:
        return F.concat(*[F.regexp_extract(tag, value % name, group) for group in (1, 2, 3)])

    def target(tag: Column) -> Column:
        return (
            F.when(F.lower(F.trim(attribute(tag, "rel"))) == "canonical", attribute(tag, "href"))
            .when(
                F.lower(attribute(tag, "http-equiv")) == "refresh",
                F.regexp_extract(attribute(tag, "content"), r"(?i)url\s*=\s*(.*)$", 1),
            )
            .when(F.lower(attribute(tag, "property")) == "og:url", attribute(tag, "content"))
        )

    found = F.filter(F.transform(tags, target), lambda t: t.isNotNull() & (t != ""))
    return F.when(likely, F.transform(found, lambda t: _resolved(t, url)))


def judge(
    pages: DataFrame,
    page_id: str,
    url: str,
    rules: Sequence[Rule],
    html: str | None = None,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``alias_of`` and ``verdict`` for every page.

    Urls of one normal form are one node. Edges are what pages declare in ``html`` and the rows of
    ``redirects`` (columns source, target). Connected components of this graph are the sets of
    aliases. A page that a rule fits has that rule's verdict: an explicit allow is never overruled.
    A page without a rule takes the decision of its aliases, direct or over any number of hops:
    allow if a rule allows one of them, else block if a rule blocks one, else allow.
    ``alias_of`` is the least normal form of the component, null for pages with no alias.

    A url that is null or has no :// has empty host and path, no rule, no aliases and is allowed.
    Repeated rows get one result row each. Empty table: empty result. Only the named columns are
    read. Decisions are reduced to two flags per node before they are shuffled; nothing is collected.
    """
    u = F.col(url)
    base = pages.select(
        F.col(page_id).alias("page_id"), host(u).alias("host"), path(u).alias("path"), normal_form(u).alias("node")
    ).withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    target_hosts = []
    if html is not None:
        named = pages.select(u.alias("source"), F.explode(declared_targets(F.col(html), u)).alias("target"))
        target_hosts.append(named)
    if redirects is not None:
        target_hosts.append(redirects.select("source", "target"))
    stored = materialize(base, "pages")
    if not target_hosts:
        return _result(stored, None)
    links = target_hosts[0]
    for more in target_hosts[1:]:
        links = links.union(more)
    edges = materialize(
        links.select(
            normal_form(F.col("source")).alias("a"),
            normal_form(F.col("target")).alias("b"),
            matching_rule(host(F.col("target")), path(F.col("target")), rules).alias("b_match"),
        )
        .where("a <> b")
        .distinct(),
        "links",
    )
    return _result(stored, edges)


def _result(base: DataFrame, edges: DataFrame | None) -> DataFrame:
    action = F.col("match")["action"]
    flags = [F.max(action == "allow").alias("allows"), F.max(action == "block").alias("blocks")]
    known = base.where(F.col("node").isNotNull() & F.col("match").isNotNull()).select("node", "match")
    if edges is None:
        groups = known.groupBy("node").agg(*flags).select(F.col("node").alias("n"), F.lit(None).cast("string").alias("alias_of"), "allows", "blocks")
    else:
        # a target that is no page of the table decides as well
        known = known.union(edges.where("b_match IS NOT NULL").select(F.col("b").alias("node"), F.col("b_match").alias("match")))
        member = components(edges, "a", "b", "aliases").withColumnRenamed("component", "alias_of")
        by_node = known.groupBy("node").agg(*flags)
        joined = by_node.join(member, "node", "full")
        group = F.coalesce("alias_of", "node")
        decided = joined.withColumn("g", group).groupBy("g").agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks"))
        groups = joined.select(F.col("node").alias("n"), "alias_of", group.alias("g")).join(decided, "g").drop("g")
    own = base.where(F.col("node").isNotNull())
    verdict = F.coalesce(
        action, F.when(F.coalesce("allows", F.lit(False)), "allow").when(F.coalesce("blocks", F.lit(False)), "block"), F.lit("allow")
    )
    final = [F.col("page_id"), F.col("host"), F.col("path"), F.col("match")["rule"].alias("rule"), F.col("alias_of"), verdict.alias("verdict")]
    with_node = own.join(groups, F.col("node") == F.col("n"), "left").select(*final)
    none = F.lit(None)
    without = base.where(F.col("node").isNull()).withColumns(
        {"alias_of": none.cast("string"), "allows": none.cast("boolean"), "blocks": none.cast("boolean")}
    )
    return with_node.union(without.select(*final))
