"""URL rules, and block decisions carried over redirects and canonical links.

A rule names a host and a path prefix; it fits the host and all its subdomains. The longest fitting rule (host and
path together; then the longer host; then allow before block) decides. URLs that redirect to each other or name one
canonical URL are one component of the link graph; if a rule blocks any URL of it, the others are blocked too, but
for those that a rule allows explicitly. The graph's nodes are URLs without fragment, with the host in lower case,
told apart by 64-bit hashes.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; null
HTML has no links; a link that isn't an absolute URL is resolved against its page; repeated rows repeat the result;
an empty table gives an empty result. Up to MOST_LITERALS rules are a literal of the plan; more of them, or a table
of rules, are joined on host suffix and path prefix. Of equal rules with both verdicts, allow counts. Links of pages
that repeat a URL add up. Columns of pages pass through, but for host, path, rule and verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.llm.shared import Tables, connected_components, small

MOST_LITERALS = 500
Rules = list[tuple[str, str, str]] | DataFrame
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL as a node: host in lower case, no fragment; null without ``://``."""
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(F.regexp_extract(url, "(?s)^(.*?)://", 1), UPPER, LOWER), F.lit("://"), host_of(url), rest))


def suffixes(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The deciding rule as a struct (rule, verdict), or null. rules: (verdict, host, path)."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append(
            F.struct(
                F.lit(len(rule_host) + len(rule_path)).alias("size"), F.lit(len(rule_host)).alias("host_size"), F.lit(int(verdict == "allow")).alias("allow"),
                F.lit(rule_path).alias("path"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"),
            )
        )
    table = F.create_map(*(x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))))
    known = F.filter(F.transform(suffixes(host), lambda h: F.try_element_at(table, h)), lambda x: x.isNotNull())
    fits = F.filter(F.flatten(known), lambda r: F.startswith(path, r["path"]))
    return F.transform(F.array(F.array_max(fits)), lambda r: F.when(r.isNotNull(), F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))))[0]


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) URLs of canonical links and of meta refreshes in the pages' HTML."""
    html, url = F.col(html_col), F.col(url_col)
    tag = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    href = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    to = F.regexp_extract(meta, r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    found = pages.where(html.rlike(r"""(?i)\brel\s*=\s*["']?canonical|http-equiv\s*=\s*["']?refresh""")).where(F.instr(url, "://") > 0)
    found = found.select(url.alias("source"), F.explode(F.array(href, to)).alias("target")).where("target <> ''")
    target, root = F.replace("target", F.lit("&amp;"), F.lit("&")), F.regexp_extract("source", "(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_replace(path_of(F.col("source")), "[^/]*$", "")
    whole = (
        F.when(F.instr(target, "://") > 0, target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract("source", "(?s)^.*?:(?=//)", 0), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )
    return found.select("source", whole.alias("target"))


def with_rule(rows: DataFrame, url_col: str, rules: Rules, tables: Tables) -> DataFrame:
    """Add __rule, the deciding rule (rule, verdict) of each row's URL, or null."""
    if isinstance(rules, list) and len(rules) <= MOST_LITERALS:
        return rows.withColumn("__rule", rule_of(host_of(F.col(url_col)), path_of(F.col(url_col)), rules))
    if isinstance(rules, list):
        rules = rows.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    allow = F.max((F.col("verdict") == "allow").cast("int")).alias("allow")
    rules = tables.write(rules.groupBy("host", "path").agg(allow), "rules")
    lengths = tables.write(rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")), "lengths")
    urls = rows.select(F.col(url_col).alias("__url")).where("__url is not null").distinct()
    parts = urls.select("__url", path_of(F.col("__url")).alias("whole"), F.explode(suffixes(host_of(F.col("__url")))).alias("host")).join(small(lengths), "host")
    parts = parts.select("__url", "host", "whole", F.explode("lengths").alias("n")).where("n <= length(whole)").select("__url", "host", F.expr("substr(whole, 1, n)").alias("path"))
    order = F.max(F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "allow", F.concat("host", "path").alias("rule")))
    found = parts.join(small(rules), ["host", "path"]).groupBy("__url").agg(order.alias("r"))
    found = tables.write(found.select("__url", F.struct(F.col("r.rule").alias("rule"), F.when(F.col("r.allow") == 1, "allow").otherwise("block").alias("verdict")).alias("__rule")), "ruled")
    return rows.join(found, rows[url_col] == found["__url"], "left").drop("__url")


def blocked_aliases(links: DataFrame, rules: Rules, tables: Tables) -> DataFrame | None:
    """The nodes (id) of components that hold a blocked URL; None if there are no links."""
    edges = links.select(node_of(F.col("source")).alias("source"), node_of(F.col("target")).alias("target")).where("source <> target").distinct()
    edges = tables.write(edges.withColumns({"a": F.xxhash64("source"), "b": F.xxhash64("target")}), "links")
    if edges.isEmpty():
        return None
    parts = connected_components(edges.select("a", "b"), tables)
    nodes = edges.select(F.col("a").alias("node"), F.col("source").alias("url")).union(edges.select("b", "target")).distinct()
    nodes = with_rule(nodes, "url", rules, tables)
    blocked = nodes.where(F.col("__rule")["verdict"] == "block").join(parts, "node").select("component").distinct()
    return tables.write(parts.join(blocked, "component").select(F.col("node").alias("__alias")).distinct(), "aliases")


def judge(pages: DataFrame, rules: Rules, links: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add host, path, rule and verdict to every page; ``links`` (source, target) adds known redirects to those in the HTML."""
    tables = Tables()
    found = links_of(pages, url_col, html_col)
    aliases = blocked_aliases(found if links is None else found.union(links.select("source", "target")), rules, tables)
    tables.drop(*(t for t in tables.held if t is not aliases))
    url = F.col(url_col)
    out = with_rule(pages.drop("host", "path", "rule", "verdict"), url_col, rules, tables)
    out = out.withColumns({"host": host_of(url), "path": path_of(url)})
    spread = F.lit(None).cast("string")
    if aliases is not None:
        out = out.withColumn("__alias", F.xxhash64(node_of(url))).join(small(aliases).withColumn("__hit", F.lit(True)), "__alias", "left")
        spread = F.when(F.col("__hit") & node_of(url).isNotNull(), F.lit("block"))
    out = out.withColumns({"rule": F.col("__rule")["rule"], "verdict": F.coalesce(F.col("__rule")["verdict"], spread, F.lit("allow"))})
    return out.drop("__rule", "__alias", "__hit")
