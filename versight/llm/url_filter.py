"""URL rules whose block decisions reach aliases. Built-in functions only.

Redirects and canonical links are edges between URLs (scheme and host lower-cased, dot
segments resolved, the fragment cut off). Relative links are resolved against the page's
URL, or its ``base`` element. Connected components over them are the groups of aliases. A URL that a
rule fits is judged by its longest rule. Another URL takes its group's decision: allow if
any member is explicitly allowed, else block if any is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from versight.llm.components import components
from versight.llm.shared import written

#: (decision, host and start of the path); the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = (r"(?is)<link\b[^>]*?\brel\s*=\s*[\x22\x27]?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)")
#: A page's own base for its links.
BASE = (r"(?is)<base\b[^>]*>", CANONICAL[1])
SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:"
ORIGIN = r"(?s)\A(.*?://[^/?#]*)"
FOLDER = r"(?s)\A(.*/)"
NODE = r"(?s)\A(.*?://[^/?#]*)([^?#]*)([^#]*)"
REFRESH = (r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\x22\x27]?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        found = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}"), rule).otherwise(found)
    return found


def _decision(rule: Column, rules) -> Column:
    out = F.lit(None).cast("string")
    for decision, r in rules:
        out = F.when(rule == r, decision).otherwise(out)
    return out


def _no_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, r"/[^/]*\z", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    walked = F.aggregate(F.slice(F.split(path, "/", -1), 2, F.length(path) + 1), F.lit(""), step)
    return F.when(path.contains("/."), F.concat(walked, F.when(path.rlike(r"/\.\.?\z"), "/").otherwise(""))).otherwise(path)


def node_of(url: Column) -> Column:
    """The URL as a node: no fragment, lower-cased scheme and host, no dot segments; null if it is none."""
    part = lambda i: F.regexp_extract(url, NODE, i)
    path = F.when(part(2) == "", "/").otherwise(_no_dots(part(2)))
    return F.when(part(1) != "", F.concat(F.translate(part(1), UPPER, LOWER), path, part(3)))


def resolve(link: Column, base: Column) -> Column:
    """A link as an absolute URL; null if it is empty or only a fragment."""
    part = lambda pattern: F.regexp_extract(base, pattern, 1)
    folder = F.regexp_extract(path_of(base), FOLDER, 1)
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(SCHEME), link)
        .when(link.startswith("//"), F.concat(part(r"(?s)\A(.*?:)//"), link))
        .when(link.startswith("/"), F.concat(part(ORIGIN), link))
        .when(link.startswith("?"), F.concat(part(r"(?s)\A(.*?://[^?#]*)"), link))
        .otherwise(F.concat(part(ORIGIN), F.when(folder == "", "/").otherwise(folder), link))
    )


def _link(html: Column, patterns: tuple[str, str]) -> Column:
    """The first link of a kind, as written."""
    return F.replace(F.regexp_extract(F.regexp_extract(html, patterns[0], 0), patterns[1], 1), F.lit("&amp;"), F.lit("&"))


def alias_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(u, v): canonical links and refreshes of the pages, and the (source, target) redirects."""
    url, html = F.col(url_col), F.col(html_col)
    own = lambda kind, hint: F.when(html.rlike(hint), _link(html, kind))
    base = own(BASE, r"(?i)<base")
    written_as = F.filter(F.array(own(CANONICAL, r"(?i)canonical"), own(REFRESH, r"(?i)http-equiv")), lambda x: x.isNotNull() & (x != ""))
    found = pages.select(url.alias("u"), base.alias("b"), F.explode(written_as).alias("t"))
    found = found.select("u", F.coalesce(resolve(F.col("b"), F.col("u")), F.col("u")).alias("b"), "t").select(node_of(F.col("u")).alias("u"), node_of(resolve(F.col("t"), F.col("b"))).alias("v"))
    if redirects is not None:
        found = found.unionByName(redirects.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")))
    return found.where("u is not null and v is not null and u != v").distinct()


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """The id, host, path, rule, verdict and reason (rule, alias or default) of each row.

    A null URL, or one without ``://``, has an empty host and path, no rule and the verdict
    allow. Null html has no links; null ids are carried; repeated rows repeat; an empty
    table gives an empty result. Only the named columns are read.
    """
    edges = written(alias_edges(pages, url_col=url_col, html_col=html_col, redirects=redirects), "aliases")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).select("_id", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = _decision(F.col("rule"), rules)
    if edges.isEmpty():  # nothing to propagate: no shuffle
        judged = rows.withColumn("group", F.lit(None).cast("string"))
    else:
        label = components(edges)
        members = label.select("u", F.col("v").alias("root")).unionByName(label.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        ruled = members.withColumn("d", _decision(rule_of(host_of(F.col("u")), path_of(F.col("u")), rules), rules))
        groups = ruled.groupBy("root").agg(F.max(F.col("d") == "allow").alias("allow"), F.max(F.col("d") == "block").alias("block"))
        decided = written(groups.select("root", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("group")).where("group is not null"), "groups")
        named = members.join(decided, "root").select(F.col("u").alias("_node"), "group")
        judged = rows.withColumn("_node", node_of(F.col("_url"))).join(written(named, "members"), "_node", "left")
    return judged.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce(own, F.col("group"), F.lit("allow")).alias("verdict"),
        F.when(own.isNotNull(), "rule").when(F.col("group").isNotNull(), "alias").otherwise("default").alias("reason"),
    )


def oracle(rules=RULES) -> str:
    """DuckDB SQL for the query: groups by a recursive search over the same links."""
    q = lambda s: s.replace("'", "''")

    def host(u):
        return f"coalesce(translate(regexp_extract({u}, '{PARTS}', 1), '{UPPER}', '{LOWER}'), '')"

    def path(u):
        return f"coalesce(regexp_extract({u}, '{PARTS}', 2), '')"

    def rule(h, p):
        cases = []
        for _, r in sorted(rules, key=lambda r: -len(r[1])):
            name, _, start = r.partition("/")
            cases.append(f"WHEN ({h} = '{name}' OR ends_with({h}, '.{name}')) AND starts_with({p}, '/{start}') THEN '{r}'")
        return f"CASE {' '.join(cases)} END"

    decision = lambda r: f"CASE {' '.join(f"WHEN {r} = '{x}' THEN '{d}'" for d, x in rules)} END"

    def bare(p):
        walked = f"list_reduce(string_split({p}, '/'), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END)"
        return rf"CASE WHEN contains({p}, '/.') THEN {walked} || CASE WHEN regexp_matches({p}, '/\.\.?$') THEN '/' ELSE '' END ELSE {p} END"

    def node(u):
        a, b, c = (f"regexp_extract({u}, '{NODE}', {i})" for i in (1, 2, 3))
        return f"CASE WHEN {a} <> '' THEN translate({a}, '{UPPER}', '{LOWER}') || CASE WHEN {b} = '' THEN '/' ELSE {bare(b)} END || {c} END"

    def link(patterns):
        return f"replace(regexp_extract(regexp_extract(html, '{q(patterns[0])}', 0), '{q(patterns[1])}', 1), '&amp;', '&')"

    def absolute(t, b):
        part = lambda pattern: f"regexp_extract({b}, '{pattern}', 1)"
        folder = f"regexp_extract({path(b)}, '{FOLDER}', 1)"
        return rf"""CASE WHEN {t} = '' OR starts_with({t}, '#') THEN NULL WHEN regexp_matches({t}, '{SCHEME}') THEN {t} WHEN starts_with({t}, '//') THEN {part(r"(?s)\A(.*?:)//")} || {t}
    WHEN starts_with({t}, '/') THEN {part(ORIGIN)} || {t} WHEN starts_with({t}, '?') THEN {part(r"(?s)\A(.*?://[^?#]*)")} || {t} ELSE {part(ORIGIN)} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {t} END"""

    return f"""
WITH RECURSIVE found AS (SELECT url, {link(BASE)} AS own, unnest([{link(CANONICAL)}, {link(REFRESH)}]) AS t FROM pages),
based AS (SELECT url, coalesce({absolute("own", "url")}, url) AS base, t FROM found),
full_ AS (SELECT url, {absolute("t", "base")} AS t FROM based),
links AS (SELECT {node("url")} AS u, {node("t")} AS v FROM full_),
e AS (SELECT u, v FROM links WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v UNION SELECT v, u FROM links WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v),
reach AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
near AS (SELECT u, {decision(rule(host("v"), path("v")))} AS d FROM reach),
g AS (SELECT u, CASE WHEN bool_or(d = 'allow') THEN 'allow' WHEN bool_or(d = 'block') THEN 'block' END AS "group" FROM near GROUP BY u),
r AS (SELECT page_id, url, {host("url")} AS host, {path("url")} AS path FROM pages),
s AS (SELECT *, {rule("host", "path")} AS rule, {node("url")} AS node FROM r)
SELECT page_id, host, path, rule, coalesce({decision("rule")}, "group", 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN "group" IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM s LEFT JOIN g ON s.node = g.u
"""
