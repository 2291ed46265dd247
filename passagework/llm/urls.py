"""URL filter with redirect equivalence.

Rules name a host and the start of a path and hold for the host's subdomains too. A page
without a fitting rule takes over the block of an alias: addresses are aliases when they are
connected by redirects and canonical links. An explicit allow rule of the page itself always
comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import LOWER, UPPER, save
from passagework.llm.graph import components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that are judged by default.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'>\s]+)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? or #, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as (name, verdict), or null; of equal length the longer host, then allow."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict, r.name))
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def resolved(path: Column) -> Column:
    """A path without its dot segments; the empty path is ``/``."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        # The first segment is what precedes the first slash and stays.
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(
            F.concat(done, F.array(s))
        ),
    )
    # A path that ends in a dot segment names a folder.
    joined = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    dotted = path.rlike(r"(?:^|/)\.\.?(?:/|$)")
    return F.when(path == "", "/").when(dotted, joined).otherwise(path)


def node_of(url: Column) -> Column:
    """What an address names: host without default port, resolved path, and query; null without a host.

    Scheme and fragment don't count. Addresses with other queries are other nodes.
    """
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, resolved(path_of(url)), query))


def _absolute(target: Column, page: Column) -> Column:
    """A link's target as an address; null where it names nothing new or another kind of thing."""
    target = F.regexp_replace(F.trim(target), r"(?s)#.*", "")
    scheme = F.regexp_extract(page, r"^([^:/?#]+):", 1)
    root = F.concat(scheme, F.lit("://"), host_of(page))
    folder = F.coalesce(F.expr("nullif(_folder, '')"), F.lit("/"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path_of(page), target))
        .when(target != "", F.concat(root, folder, target))
    )


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): links between nodes, from redirects in pages and their canonical links."""
    page = F.col(url)
    tags = pages.select(
        page.alias("page"), F.regexp_extract(path_of(page), r"(?s)^(.*/)", 1).alias("_folder"),
        F.explode(F.regexp_extract_all(F.col(html), F.lit(_TAG), F.lit(0))).alias("tag"),
    )
    canonical = F.when(
        F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", _HREF, 1)
    )
    moved = F.when(
        F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", _REFRESH, 1)
    )
    ends = tags.select("page", "_folder", F.coalesce(canonical, moved).alias("target")).where("target != ''")
    return ends.select(
        node_of(F.col("page")).alias("a"), node_of(_absolute(F.col("target"), F.col("page"))).alias("b")
    ).where("a is not null and b is not null and a != b").distinct()


def judged(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
    rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None,
) -> DataFrame:
    """One row per page: (_id, host, path, rule, verdict, group).

    ``rule`` is the name of the page's own rule, whose verdict holds. A page without one is
    blocked when a rule blocks an alias: a page of its group or the end of a link in it, also
    where no page was fetched for that address; it is allowed otherwise. ``redirects`` may
    add further (a, b) links of addresses. Groups come from links alone: addresses that only
    look alike, or differ in their query, are not aliases.

    Null addresses and those without :// have no host, no rule, no alias, and are allowed.
    Null html has no links. Repeated rows are judged alike; null ids are judged; an empty
    table gives an empty result; other columns are not looked at.
    """
    links = alias_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(
            node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")
        ).where("a is not null and b is not null"))
    groups = save(components(links), "groups")
    address = F.col("_url")
    own = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url")).select(
        "_id", host_of(address).alias("host"), path_of(address).alias("path"), node_of(address).alias("node")
    ).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    # Addresses without a node are spread over the tasks; they match nothing.
    spread = F.when(F.col("node").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0))
    placed = save(
        own.withColumn("_spread", spread.cast("long")).join(
            groups.withColumn("_spread", F.lit(0).cast("long")), ["node", "_spread"], "left"
        ).drop("_spread"), "pages"
    )
    # Only groups of links can hand on a block; every other page stands for itself.
    ends = groups.select("component", rule_of(
        F.regexp_extract("node", r"(?s)^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1), rules
    ).alias("own"))
    named = ends.unionByName(placed.where("component is not null").select("component", "own"))
    blocked = named.where("own.verdict = 'block'").select("component").distinct().withColumn("blocked", F.lit(True))
    alone = placed.where("component is null").withColumn("blocked", F.lit(None).cast("boolean"))
    grouped = placed.where("component is not null").join(blocked, "component", "left")
    return alone.unionByName(grouped).select(
        "_id", "host", "path", F.col("own.name").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("component", "node").alias("group"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``judged``."""
    return found.select(F.col("_id").alias("page_id"), "host", "path", "rule", "verdict")
