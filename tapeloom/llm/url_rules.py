"""Allow and block rules for URLs, passed on along redirects and canonical links."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import connected_components
from .registry import query


class Rule(NamedTuple):
    verdict: str  #: allow or block
    host: str
    path: str


#: More rules than this do not belong in a query plan.
MOST_RULES = 10_000


def host_of(url: Column) -> Column:
    return _lower_ascii(_part(url, r"(?s)^.*?://([^/?#]*)"))


def path_of(url: Column) -> Column:
    return _part(url, r"(?s)^.*?://[^/?#]*([^?#]*)")


def _part(url: Column, pattern: str) -> Column:
    """What the pattern's group holds; empty for a null url or one without ``://``."""
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as struct(length, rule, verdict); null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules sit in one
    literal map by host, so a URL looks at the rules of its own host names only. Of rules of equal length
    the one that sorts last decides.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    kind = "struct<length:int,rule:string,verdict:string,path:string>"
    if not rules:
        return F.lit(None).cast(kind)

    def literal(r: Rule) -> Column:
        name = r.host + r.path
        return F.struct(F.lit(len(name)).alias("length"), F.lit(name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))

    known = F.create_map(*[x for h, own in sorted(by_host.items()) for x in (F.lit(h), F.array(*[literal(r) for r in own]))])
    labels = F.split(host, r"\.")
    n = F.size(labels)
    names = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    near = F.flatten(F.transform(names, lambda h: F.coalesce(F.try_element_at(known, h), F.array().cast(f"array<{kind}>"))))
    return F.array_max(F.filter(near, lambda r: F.startswith(path, r["path"])))


def node_of(url: Column) -> Column:
    """The URL as a graph node: scheme and host in lower case, no fragment; null without ``://``."""
    scheme = _lower_ascii(_part(url, r"(?s)^(.*?)://"))
    query_part = _part(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?")
    path = path_of(url)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query_part))


# How pages write a canonical link (as any word of rel) and a refresh, and where their targets stand.
_LINK, _META = r"(?is)<link[^>]*>", r"(?is)<meta[^>]*>"
_CANONICAL = r"(?is)\srel\s*=\s*(\"([^\"]*\s)?canonical(\s[^\"]*)?\"|'([^']*\s)?canonical(\s[^']*)?'|canonical([\s/>]))"
_REFRESH = r"(?is)\shttp-equiv\s*=\s*[\"']?refresh"
_HREF, _TO = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)", r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)"
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&"))
_ABSOLUTE, _OTHER = r"^[A-Za-z][A-Za-z0-9+.\-]*://", r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments taken out."""
    def step(done: Column, segment: Column) -> Column:
        return F.when(segment == ".", done).when(segment == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), segment))

    parts = F.split(path, "/")
    done = F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), step)
    return F.when(path.rlike(r"/\.\.?$") | (done == ""), F.concat(done, F.lit("/"))).otherwise(done)


def resolved(url: Column, to: Column) -> Column:
    """The target ``to`` of a link on page ``url``: absolute, from the scheme, the root, the page's folder or its query;
    null for fragments and for other schemes (``mailto:``)."""
    for entity, plain in _ENTITIES:
        to = F.replace(to, F.lit(entity), F.lit(plain))
    scheme, host, path = _part(url, r"(?s)^(.*?)://"), host_of(url), path_of(url)
    base = F.concat(scheme, F.lit("://"), host)
    way, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    from_root = F.concat(base, _without_dots(way), rest)
    return (
        F.when(to.rlike(_ABSOLUTE), to).when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to)).when(F.startswith(to, F.lit("/")), from_root)
        .when(to.rlike(_OTHER) | F.startswith(to, F.lit("#")), F.lit(None))
        .when(F.startswith(to, F.lit("?")), F.concat(base, F.when(path == "", "/").otherwise(path), to))
        .otherwise(F.concat(base, _without_dots(F.concat(folder, way)), rest))
    )


def declared_links(pages: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that pages state in ``html``: canonical links and refresh redirects."""
    canonical = F.filter(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), lambda t: t.rlike(_CANONICAL))
    targets = F.transform(canonical, lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.filter(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda t: t.rlike(_REFRESH))
    redirected = F.transform(refresh, lambda t: F.regexp_extract(t, _TO, 1))
    found = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & (F.instr("url", "://") > 0))
    found = found.select("url", F.explode(F.concat(targets, redirected)).alias("to")).where("to <> ''")
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.col("to"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A page that a rule fits has that rule's verdict: an explicit allow holds whatever its aliases are, and
    so does an explicit block. Another page is blocked if a rule blocks any alias, that is any URL in its
    connected component of ``links(a, b)`` (a redirect log, by node as ``node_of`` writes it) and of the
    links that pages declare; otherwise it has the ``default``. URLs that differ in the fragment or in the
    case of scheme and host only are one node. Null URLs and those without ``://`` have empty host and
    path, fit no rule and have no aliases. Links, components and verdicts stay distributed; only blocked
    nodes without a rule of their own reach the pages.
    """
    url = F.col("url")
    given = declared_links(pages)
    if links is not None:
        given = given.unionByName(links.select("a", "b"))
    edges = stored(given, "url-links")
    judged = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    judged = judged.withColumn("__found", rule_for(F.col("host"), F.col("path"), rules))
    own = F.col("__found.verdict")
    if edges.isEmpty():
        alias = F.lit(None).cast("string")
    else:
        member = stored(connected_components(edges, "url-components"), "url-members")
        node = F.col("node")
        member = member.withColumn("own", rule_for(host_of(node), path_of(node), rules)["verdict"])
        bad = stored(member.where("own = 'block'").select("component").distinct(), "url-blocked")
        # A URL without a path is the node of the root, yet a rule for the root's path does not fit it.
        blocked = member.where(F.col("own").isNull() | (path_of(node) == "/")).join(bad, "component", "left_semi").select(node.alias("__node"), F.lit("block").alias("__alias"))
        judged = judged.withColumn("__node", node_of(url)).join(stored(blocked, "url-aliases"), "__node", "left")
        alias = F.col("__alias")
    judged = judged.withColumns({"rule": F.col("__found.rule"), "verdict": F.coalesce(own, alias, F.lit(default))})
    return judged.drop("__found", "__node", "__alias")


RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _node_sql(url: str) -> str:
    def part(pattern: str) -> str:
        return f"coalesce(regexp_extract({url}, '{pattern}', 1), '')"

    host = f"translate({part('(?s)^.*?://([^/?#]*)')}, '{_UPPER}', '{_LOWER}')"
    scheme, path = f"translate({part('(?s)^(.*?)://')}, '{_UPPER}', '{_LOWER}')", part("(?s)^.*?://[^/?#]*([^?#]*)")
    tail = part("(?s)^.*?://[^/?#]*[^?#]*([?][^#]*)?")
    return f"CASE WHEN contains({url}, '://') THEN {scheme} || '://' || {host} || coalesce(nullif({path}, ''), '/') || {tail} END"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _decoded_sql(text: str) -> str:
    for entity, plain in _ENTITIES:
        text = f"replace({text}, '{entity}', '{_sql(plain)}')"
    return text


def _found_sql(source: str, url: str) -> str:
    """Rows of ``source`` with host, path and the deciding rule."""
    host = f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    path = f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    return f"""SELECT h.*, r.rule, r.verdict AS own FROM (SELECT *, {host} AS host, {path} AS path FROM {source}) h
  LEFT JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
  QUALIFY row_number() OVER (PARTITION BY h.k ORDER BY len(r.rule) DESC NULLS LAST, r.rule DESC) = 1"""


SQL = rf"""WITH RECURSIVE rules(verdict, rhost, rpath, rule) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.host}{r.path}')" for r in RULES)}),
p AS (SELECT row_number() OVER () AS k, page_id, url, html FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '{_LINK}')) AS tag, '{_sql(_CANONICAL)}' AS kind, '{_sql(_HREF)}' AS target FROM p
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '{_META}')), '{_sql(_REFRESH)}', '{_sql(_TO)}' FROM p),
t AS (SELECT url, {_decoded_sql("regexp_extract(tag, target, 1)")} AS x FROM tags WHERE contains(url, '://') AND regexp_matches(tag, kind)),
u AS (SELECT url, x, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS base, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(x, '(?s)^([^?#]*)', 1) AS way, regexp_extract(x, '(?s)^[^?#]*(.*)$', 1) AS rest FROM t WHERE x <> ''),
v AS (SELECT *, CASE WHEN starts_with(way, '/') THEN way ELSE coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || way END AS full_path FROM u),
n AS (SELECT *, list_reduce(string_split(full_path, '/')[2:], lambda d, g: CASE WHEN g = '.' THEN d WHEN g = '..' THEN regexp_replace(d, '/[^/]*$', '') ELSE d || '/' || g END, '') AS done FROM v),
w AS (SELECT url, CASE WHEN regexp_matches(x, '{_ABSOLUTE}') THEN x WHEN starts_with(x, '//') THEN scheme || ':' || x WHEN NOT starts_with(x, '/') AND (regexp_matches(x, '{_OTHER}') OR starts_with(x, '#')) THEN NULL
  WHEN starts_with(x, '?') THEN base || coalesce(nullif(path, ''), '/') || x ELSE base || CASE WHEN regexp_matches(full_path, '/\.\.?$') OR done = '' THEN done || '/' ELSE done END || rest END AS x FROM n),
e AS (SELECT {_node_sql("url")} AS a, {_node_sql("x")} AS b FROM w),
edges AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
nodes AS (SELECT row_number() OVER () AS k, a AS node FROM (SELECT DISTINCT a FROM edges)),
judged AS ({_found_sql("nodes", "node")}),
bad AS (SELECT node FROM judged WHERE own = 'block' UNION SELECT edges.b FROM bad JOIN edges ON edges.a = bad.node),
f AS ({_found_sql("p", "url")})
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN {_node_sql("url")} IN (SELECT node FROM bad) THEN 'block' END, 'allow') AS verdict FROM f"""


@query("op7_redirect_equivalence", SQL)
def op7_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; repeated rows each return a row."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
