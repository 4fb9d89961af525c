"""URL filters with redirect equivalence (DataFrame functions only).

Rules judge a URL by host suffix and path prefix. URLs that redirect to, or name as canonical, one
another are aliases: connected components over those edges carry block decisions to members that no
rule of their own covers. An explicit allow has precedence, on the page itself and in its component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, UPPER, connected_components

#: (action, host, path): the default rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Hosts with rules up to which these are broadcast; tasks that a frequent host suffix is dealt to beyond that.
MAX_BROADCAST, SALTS = 200_000, 64
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def key_of(url: Column) -> Column:
    """A URL's identity: host, path and query; scheme and fragment are left out. Null for what isn't a URL."""
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query))


def _resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments. What follows ``?`` or ``#`` stays as it is."""
    only, rest = F.regexp_extract(path, r"(?s)^([^?#]*)", 1), F.regexp_extract(path, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(only, "/")
    last = F.element_at(parts, -1)
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    end = F.when(last.isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), end, rest)


def _absolute(link: Column, url: Column) -> Column:
    """A link as found on the page of a URL, made absolute: ``&amp;`` read as ``&``, and paths without dot segments."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    here = F.concat(F.lit("http://"), host_of(url))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return (
        F.when(link == "", None)
        .when(F.instr(link, "://") > 0, link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(here, _resolved(link)))
        .when(F.startswith(link, F.lit("?")), F.concat(here, path, link))
        .when(F.startswith(link, F.lit("#")), url)
        .otherwise(F.concat(here, _resolved(F.concat(F.regexp_replace(path, r"[^/]*$", ""), link))))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` URL keys: canonical links and meta redirects that pages name."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1))
    each = pages.select("url", F.explode(links).alias("link")).where("link <> ''")
    edges = each.select(key_of(F.col("url")).alias("src"), key_of(_absolute(F.col("link"), F.col("url"))).alias("dst"))
    return edges.where("src is not null and dst is not null").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    rules: ``(action, host, path)``, as a list or a table of any size. A rule fits its host and that
    host's subdomains, if the URL's path starts with the rule's; the longest rule wins (then the longer
    host, then allow). redirects: more edges as ``(src_url, dst_url)``, besides those in the html.
    Pages that no rule fits: block if their component holds a blocked and no allowed URL, else
    ``default``. Null or unparsable URLs have empty host and path, no rule and no aliases. Repeated
    pages are judged alike, each with a row of its own. Other columns are not looked at, whatever their
    names. A URL that very many pages have is a frequent key of the last joins, which adaptive execution deals
    to several tasks.
    """
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "action string, host string, path string")
    rules = rules.select(F.col("action"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).where("rule_host is not null and rule_path is not null").distinct()
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(key_of(F.col("src_url")), key_of(F.col("dst_url"))).where("src_url is not null and dst_url is not null")).dropna()
    # Every alias is judged, also those that are only linked to: their keys are host and path (and query).
    aliases = connected_components(edges)
    linked = aliases.select(F.regexp_extract("node", r"(?s)^([^/]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1).alias("path"))
    places = rows.select("host", "path").union(linked).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # A host's rules are looked up by the lengths that their paths have, so that a host of very many rules
    # meets each place in a few rows, not in one for each rule.
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    named = places.select("host", "path", F.explode(suffix).alias("rule_host"))
    if lengths.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        sized = named.join(F.broadcast(lengths), "rule_host")
    else:
        # A suffix such as com is in very many places: these go to SALTS tasks, and its lengths to each of them.
        salted = named.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)))
        sized = salted.join(lengths.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["rule_host", "salt"])
    sized = sized.select("host", "path", "rule_host", F.explode("lengths").alias("length")).where(F.col("length") <= F.length("path"))
    fits = sized.select("host", "path", "rule_host", F.substring("path", F.lit(1), F.col("length")).alias("rule_path")).join(rules, ["rule_host", "rule_path"])
    best = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.when(F.col("action") == "allow", 1).otherwise(0))
    ruled = fits.groupBy("host", "path").agg(F.max_by(F.struct("action", F.concat("rule_host", "rule_path").alias("rule")), best).alias("won"))
    ruled = ruled.select("host", "path", F.col("won.action").alias("action"), F.col("won.rule").alias("rule"))
    spots = aliases.select("node", "component", F.regexp_extract("node", r"(?s)^([^/]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1).alias("path"))
    decided = spots.join(ruled, ["host", "path"], "left").groupBy("component").agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"))
    by_key = aliases.join(decided, "component").select(F.col("node").alias("key"), F.when(F.col("blocked") & ~F.coalesce(F.col("allowed"), F.lit(False)), "block").alias("inherited"))
    out = rows.where("key is not null").join(ruled, ["host", "path"], "left").join(by_key, "key", "left")
    out = out.select("page_id", "host", "path", "rule", F.coalesce("action", "inherited", F.lit(default)).alias("verdict"))
    # What is no URL goes past the joins, where it would all be one key.
    return out.union(rows.where("key is null").select("page_id", "host", "path", F.lit(None).cast("string"), F.lit(default)))
