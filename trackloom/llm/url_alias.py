"""URL filter with redirect equivalence.

Rules of host and path decide about URLs. Pages that name another URL as canonical (a link tag) or redirect to it (a meta refresh) are
equivalent to it: connected components over those edges, found in distributed rounds, share decisions. A page's own rule stands. Without
one, it is allowed if any member of its component is allowed by a rule, else blocked if any is blocked, else allowed.

A URL without ``://`` or a null one has an empty host and path, fits no rule and takes part in no edge. A null page has no links. Of
several canonical or refresh tags the first counts; repeated pages and further columns need no care; no pages give no rows. Two URLs
are one node if host (lower case), path and query agree as text; scheme and fragment do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed
from .blocks import counts_of, dealt_join
from .components import connected_components

#: (verdict, host and path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ATTRIBUTE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The key of a URL: null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host(url), path(url), query))


def fits(host: Column, path: Column, rule: str) -> Column:
    rule_host, _, rest = rule.partition("/")
    return ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(f"/{rest}"))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...], verdict: bool = False) -> Column:
    """The longest rule that fits (or its verdict), null if none does; of equally long ones the first in alphabetical order."""
    found = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        found = F.when(fits(host, path, rule), F.lit(says if verdict else rule)).otherwise(found)
    return found


def attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\b{name}{ATTRIBUTE}"
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def absolute(base: Column, link: Column) -> Column:
    """A link as a URL: null if empty or without a place. Relative links are resolved against the page's host and folder."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"(?s)^(.*?://)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when((link == "") | link.isNull() | F.startswith(link, F.lit("#")), F.lit(None))
        .when(F.locate("://", link) > 0, link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(scheme, host(base), link))
        .otherwise(F.concat(scheme, host(base), F.when(folder == "", "/").otherwise(folder), link))
    )


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of the pages that name a canonical URL or redirect to one."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    canonical = attribute(F.regexp_extract(html, CANONICAL, 0), "href")
    refresh = F.regexp_extract(attribute(F.regexp_extract(html, REFRESH, 0), "content"), TARGET, 1)
    found = pages.where(F.locate("://", url) > 0).select("url", F.explode(F.array(absolute(url, canonical), absolute(url, refresh))).alias("target"))
    return found.where("target is not null")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    key = lambda c: node(F.col(c))
    ends = checkpointed(links(pages).select(key("url").alias("node"), key("target").alias("other")).distinct())
    # A node is numbered by its row in a written table, so two URLs share a number only if they are the same text.
    split = F.split("node", r"\?", 2)[0]
    nodes = checkpointed(
        ends.select(F.explode(F.array("node", "other")).alias("node")).distinct()
        .select("node", F.monotonically_increasing_id().alias("id"), rule_of(F.substring_index(split, "/", 1), F.regexp_extract(split, r"(?s)^[^/]*(.*)$", 1), rules, True).alias("says"))
    )
    numbers = nodes.select("node", "id")
    first = dealt_join(ends, numbers, "node", "other", counts_of(ends, "node")).select(F.col("id").alias("a"), F.col("other").alias("node"))
    edges = dealt_join(first, numbers, "node", "a", counts_of(first, "node")).select("a", F.col("id").alias("b"))
    groups = connected_components(edges)
    decided = nodes.where("says is not null").select("id", "says")
    shared = groups.join(decided, "id").groupBy("component").agg(F.when(F.max((F.col("says") == "allow").cast("int")) == 1, "allow").otherwise("block").alias("says"))
    # A component with a third of all nodes has one row on the side that decides; its other side is dealt over parts.
    by_node = dealt_join(groups, shared, "component", "id", counts_of(groups, "component")).join(numbers, "id").select("node", "says")
    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), key("url").alias("node"))
    judged = judged.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "own": rule_of(F.col("host"), F.col("path"), rules, True)})
    settled = judged.where("own is not null or node is null").select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    open_ = judged.where("own is null and node is not null").join(by_node, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("says", F.lit("allow")).alias("verdict"))
    return settled.unionAll(open_)


def oracle(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same in DuckDB's SQL."""

    def host_of(u: str) -> str:
        return f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def path_of(u: str) -> str:
        return f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

    def case(h: str, p: str, verdict: bool) -> str:
        whens = []
        for says, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
            a, _, b = rule.partition("/")
            whens.append(f"WHEN ({h} = '{a}' OR ends_with({h}, '.{a}')) AND starts_with({p}, '/{b}') THEN '{says if verdict else rule}'")
        return f"CASE {' '.join(whens)} END"

    def node_of(u: str) -> str:
        return f"{host_of(u)} || {path_of(u)} || coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)?', 1), '')"

    def attr(tag: str, name: str) -> str:
        a = ATTRIBUTE.replace("'", "''")
        return "(" + " || ".join(f"regexp_extract({tag}, '(?is)\\b{name}{a}', {i})" for i in (1, 2, 3)) + ")"

    canonical, refresh, target = (x.replace("'", "''") for x in (CANONICAL, REFRESH, TARGET))
    return f"""
WITH RECURSIVE raw AS (
  SELECT url, trim(replace(unnest([{attr(f"regexp_extract(coalesce(html, ''), '{canonical}', 0)", "href")},
         regexp_extract({attr(f"regexp_extract(coalesce(html, ''), '{refresh}', 0)", "content")}, '{target}', 1)]), '&amp;', '&')) AS link
  FROM pages WHERE contains(url, '://')),
ends AS (
  SELECT url, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://)', 1) || {host_of('url')} || link
    ELSE regexp_extract(url, '(?s)^(.*?://)', 1) || {host_of('url')} || CASE WHEN regexp_replace({path_of('url')}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({path_of('url')}, '[^/]*$', '') END || link END AS target
  FROM raw WHERE link <> '' AND NOT starts_with(link, '#')),
pairs AS (SELECT {node_of('url')} AS a, {node_of('target')} AS b FROM ends UNION SELECT {node_of('target')}, {node_of('url')} FROM ends),
reach AS (SELECT a AS origin, a AS reached FROM pairs UNION SELECT origin, b FROM reach JOIN pairs ON reached = a),
decided AS (
  SELECT {node_of('u')} AS node, max({case(host_of('u'), path_of('u'), True)}) AS says FROM (SELECT url AS u FROM ends UNION SELECT target FROM ends) GROUP BY 1),
shared AS (SELECT origin, min(says) AS says FROM reach JOIN decided ON reached = node WHERE says IS NOT NULL GROUP BY origin),
split AS (SELECT page_id, url, {host_of('url')} AS host, {path_of('url')} AS path FROM pages)
SELECT page_id, host, path, {case('host', 'path', False)} AS rule, coalesce({case('host', 'path', True)}, shared.says, 'allow') AS verdict
FROM split LEFT JOIN shared ON contains(url, '://') AND origin = {node_of('url')}
"""
