"""URL filters with redirect equivalence: block decisions reach all aliases of an address.

An address is host, path and query of a URL; scheme and fragment tell no two addresses apart.  Edges join an address with the
target of its page's canonical link and meta refresh, and with further redirects given as a table.  Connected components of
these edges are the aliases of a resource.

Verdicts: a rule that fits an address decides it.  Without one, the address takes part in its component: it is allowed if a
rule allows some alias (explicit allow takes precedence), else blocked if a rule blocks some alias, else ``allow``.

Only DataFrame functions are used.  Rules are found by equality: a host's suffixes meet the rules' hosts and the lengths of their
paths, and the path's beginning of such a length meets the rules.  Components alternate large-star and small-star steps;
a vertex's smallest neighbour is a minimum that combines before the shuffle, and vertices with very many edges are joined in
place (:func:`plotline.llm.spread.join_per_key`).  Every round is a written table.

Defined cases: a NULL URL, or one without ``://``, has empty host and path, fits no rule but one of empty host and path, is no
vertex and is allowed; NULL or broken HTML has no links; relative targets are resolved against the page; targets that are no
http address (``mailto:``) are no edges; repeated rows are judged alike, each on its own; empty tables give no rows.  Of rules of
equal length the one with the longer host wins, of equal rules an allow.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotline.llm.spread import join_per_key
from plotline.session import stage

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed by the contract of the query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# Tags and attributes; possessive, so that no input makes the matcher step back.
_TAG = r"""(?is)<(?:link|meta)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = tuple(RULES)) -> DataFrame:
    """``(verdict, host, path)`` rules as a table."""
    one = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*one)))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query as one text; NULL without a host."""
    query = F.regexp_extract(_after_scheme(url), r"\A[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; empty if absent.  ``&amp;`` is resolved."""
    got = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", 1)
    return F.replace(F.regexp_replace(got, r"""\A["']|["']\z""", ""), F.lit("&amp;"), F.lit("&"))


def link_targets(html: Column) -> Column:
    """Array of the canonical and meta-refresh targets of a page, as written."""
    shown = F.regexp_replace(html, _HIDDEN, " ")
    tags = F.regexp_extract_all(shown, F.lit(_TAG), F.lit(0))
    canonical = lambda t: _attribute(t, "rel").rlike(r"(?i)(\A|\s)canonical(\s|\z)") & t.rlike(r"(?i)\A<link")
    refresh = lambda t: _attribute(t, "http-equiv").rlike(r"(?i)\A\s*refresh\s*\z") & t.rlike(r"(?i)\A<meta")
    goal = lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)\A\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?['"]?([^'"]*)""", 1)
    found = F.transform(tags, lambda t: F.when(canonical(t), _attribute(t, "href")).when(refresh(t), goal(t)))
    return F.filter(F.transform(found, lambda u: F.trim(F.regexp_replace(u, r"[\t\r\n]", ""))), lambda u: u.isNotNull() & (u != ""))


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    out = F.array_join(kept, "/")
    return F.when(path.rlike(r"(\A|/)\.\.?(/|\z)"), F.when(out == "", F.lit("/")).otherwise(out)).otherwise(path)


def resolve(target: Column, page: Column) -> Column:
    """The full URL of a link on a page; NULL if it is no http address or leads to a place on the page itself."""
    root = F.concat(F.lit("x://"), host_of(page))
    path, rest = F.regexp_extract(target, r"\A[^?#]*", 0), F.regexp_extract(target, r"\A[^?#]*(.*)", 1)
    folder = F.concat(F.regexp_extract(path_of(page), r"(?s)\A(.*)/", 1), F.lit("/"))
    return (
        F.when(target.rlike(r"(?i)\Ahttps?://"), target)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("?"), F.concat(root, path_of(page), target))
        .when(target.startswith("/"), F.concat(root, _without_dots(path), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` addresses that the canonical and refresh links of ``pages`` join, no address with itself."""
    linked = pages.select("url", "html").where(F.col("html").rlike(r"(?i)canonical|http-equiv") & (host_of(F.col("url")) != ""))
    each = linked.select("url", F.explode(link_targets(F.col("html"))).alias("__target"))
    return _distinct_edges(each.select(address_of(F.col("url")).alias("a"), address_of(resolve(F.col("__target"), F.col("url"))).alias("b")))


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)`` of the distinct ``places`` ``(host, path)`` that a rule fits, the longest one."""
    best = F.min(F.struct(F.when(F.col("verdict") == ALLOW, 0).otherwise(1).alias("n"), "verdict")).alias("b")
    rules = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(best).select("r_host", "r_path", F.col("b.verdict").alias("verdict"))
    shapes = rules.select(F.col("r_host").alias("s_host"), F.length("r_path").alias("s_len")).distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = places.withColumn("s_host", F.explode(suffixes)).join(shapes, "s_host").where(F.col("s_len") <= F.length("path"))
    tried = tried.select("host", "path", F.col("s_host").alias("r_host"), F.expr("left(path, s_len)").alias("r_path"))
    longest = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host")))
    return tried.join(rules, ["r_host", "r_path"]).groupBy("host", "path").agg(longest.alias("b")).select("host", "path", "b.rule", "b.verdict")


def _stars(links: DataFrame) -> DataFrame:
    """A large-star and a small-star step over written edges from the larger to the smaller vertex."""
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both_ways")
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = join_per_key(both.where("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = stage(_distinct_edges(large), "large_star")
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = join_per_key(large, low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stage(_distinct_edges(small.unionByName(low.select("a", F.col("m").alias("b")))), "small_star")


def aliases(edges: DataFrame) -> DataFrame:
    """``(address, resource)`` of every vertex of ``edges``; the resource is the smallest address of the component."""
    links = stage(_distinct_edges(edges), "links")
    last = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last, links = state, _stars(links)
    return links.select(F.col("a").alias("address"), F.col("b").alias("resource")).unionByName(
        links.select(F.col("b").alias("address"), F.col("b").alias("resource")).distinct()
    )


def _split(address: str) -> tuple[Column, Column]:
    whole = F.concat(F.lit("x://"), F.col(address))
    return host_of(whole), path_of(whole)


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages``.

    ``redirects``: further ``(source, target)`` URLs, for example from a crawler's log.  HTML stays where it is read; URLs
    are shuffled once to find those that take part in a component.
    """
    edges = page_edges(pages)
    if redirects is not None:
        more = redirects.select(address_of(F.col("source")).alias("a"), address_of(F.col("target")).alias("b"))
        edges = _distinct_edges(edges.unionByName(more))
    known = stage(aliases(edges), "aliases")
    host, path = _split("address")
    known = known.withColumns({"host": host, "path": path})
    places = known.select("host", "path").distinct()
    ruled = known.join(fitting_rules(places, rules).drop("rule"), ["host", "path"])
    counts = ruled.groupBy("resource").agg(F.max((F.col("verdict") == ALLOW).cast("int")).alias("__allows"), F.max((F.col("verdict") == BLOCK).cast("int")).alias("__blocks"))
    shut = stage(counts.where("__allows = 0 and __blocks = 1").select("resource", F.lit(BLOCK).alias("__shut")), "blocked_resources")
    shut = join_per_key(stage(known.select("address", "resource"), "known"), shut, ["resource"]).select("address", "__shut")

    url = F.col("url")
    rows = stage(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address")), "urls")
    found = stage(fitting_rules(rows.select("host", "path").distinct(), rules), "fitting_rules")
    rows = stage(join_per_key(rows, found, ["host", "path"], "left"), "ruled")
    # Only rows without a rule ask for their aliases.
    open_rows = join_per_key(rows.where("rule is null"), shut, ["address"], "left")
    open_rows = open_rows.withColumn("verdict", F.coalesce("__shut", F.lit(ALLOW))).drop("__shut")
    return rows.where("rule is not null").unionByName(open_rows).select("page_id", "host", "path", "rule", "verdict")
