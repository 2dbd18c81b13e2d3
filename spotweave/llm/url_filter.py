"""URL verdicts: rules on hosts and paths, spread over classes of equivalent URLs.

A rule names a host and the start of a path. It fits its host and all subdomains where the URL's path starts with
the rule's; of several that fit, the longest wins. Rules are joined by the host's suffixes and the path's
beginnings, of which a URL has no more than the rules have numbers of labels and lengths.

Redirects and canonical links make URLs equivalent: their connected components are found by joins, and a block
by rule reaches every URL of its class that has no rule of its own. An explicit allow thus takes precedence over
a block from an alias, and does not lift the block from other aliases. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm.common import components
from spotweave.session import materialize

HOT_PARTS = 1000  # URLs that hold above one part in so many of all rows number fewer than this, and are broadcast
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[ \t\r\n\f]"
#: What holds no tags: comments and scripts.
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>"
CANONICAL = rf"(?is)<link{_GAP}[^>]*rel{_GAP}*={_GAP}*[\x22']?canonical[\x22' \t\r\n\f/>][^>]*>?"
REFRESH = rf"(?is)<meta{_GAP}[^>]*http-equiv{_GAP}*={_GAP}*[\x22']?refresh[\x22' \t\r\n\f/>][^>]*>?"
HREF = rf"(?is)href{_GAP}*={_GAP}*[\x22']?([^\x22'> \t\r\n\f]+)"
REFRESH_URL = rf"(?is)url{_GAP}*={_GAP}*[\x22']?([^\x22'> \t\r\n\f]+)"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) from a list; a verdict is ``allow`` or ``block``."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the path, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a query, a fragment or the end."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL without scheme and fragment, its host lower-cased; null where it has no ``://``."""
    whole = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rooted = F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rooted))


def _resolved(base: Column, target: Column) -> Column:
    """The absolute URL of a link on a page; dot segments stay as they are."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(base), target))
        .when(target.startswith("#"), base)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_targets(url: Column, html: Column) -> Column:
    """Absolute URLs that a page names as its canonical form or sends its readers to, as an array without null."""
    seen = F.regexp_replace(html, HIDDEN, " ")
    canonical = F.transform(F.regexp_extract_all(seen, F.lit(CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, HREF, 1))
    refresh = F.transform(F.regexp_extract_all(seen, F.lit(REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1))
    named = F.filter(F.concat(canonical, refresh), lambda t: t != "")
    absolute = F.transform(named, lambda t: _resolved(url, F.replace(t, F.lit("&amp;"), F.lit("&"))))
    none = F.array().cast("array<string>")
    # most pages have no such tag: they are told by one plain search
    return F.when((F.instr(url, "://") > 0) & html.rlike("(?i)canonical|refresh"), F.filter(absolute, lambda t: t.isNotNull())).otherwise(none)


def fitting_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, rule, rule_verdict) of the ``nodes`` (node, host, path) that a rule fits, the longest of them.

    Of equally long ones the one with the longer host wins, then an allow.
    """
    clean = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    clean = clean.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    clean = materialize(clean, "url-rules")
    labels = F.size(F.split("rule_host", r"\."))
    # sets of small numbers: how many labels hosts of rules have, and how long their paths are
    counts = [r[0] for r in clean.select(labels).distinct().collect()]
    lengths = [r[0] for r in clean.select(F.length("rule_path")).distinct().collect()]
    if not counts:
        return nodes.select("node", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict")).limit(0)
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in counts]))
    starts = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))
    tried = nodes.select("node", F.explode(suffixes).alias("rule_host"), starts.alias("starts"))
    tried = tried.select("node", "rule_host", F.explode("starts").alias("rule_path"))
    found = tried.join(clean, ["rule_host", "rule_path"]).withColumn("rule", F.concat("rule_host", "rule_path"))
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("verdict") == "allow", "rule", "verdict"))
    return found.groupBy("node").agg(best.alias("b")).select("node", "b.rule", F.col("b.verdict").alias("rule_verdict"))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    carried: list[str],
    url: str = "url",
    html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """The ``carried`` columns of every row of ``pages`` with ``_host``, ``_path``, ``_rule`` (null where none fits) and ``_verdict``.

    ``_verdict`` is the rule's, else ``block`` if an equivalent URL is blocked by a rule, else ``allow``. Equivalent
    are URLs that differ in scheme and fragment only, those that canonical links and refresh tags of ``html`` join
    and those of ``redirects`` (from_url, to_url); URLs that are no pages count too. A null URL or one without
    ``://`` has empty host and path, no rule and the verdict ``allow``; a null html names no target. Rows that
    repeat are judged alike, each by itself. An empty table gives an empty table. Rules with a null or another verdict are
    not used.
    """
    address = F.col(url)
    targets = alias_targets(address, F.col(html)) if html else F.array().cast("array<string>")
    slim = pages.select(
        F.struct(*[pages[c] for c in carried]).alias("row"),
        host_of(address).alias("host"),
        path_of(address).alias("path"),
        F.sha2(node_of(address), 256).alias("node"),
        targets.alias("targets"),
    )
    slim = materialize(slim, "url-pages")
    n_rows = slim.count()

    links = slim.select("node", F.explode("targets").alias("to"))
    if redirects is not None:
        logged = redirects.select(F.sha2(node_of(F.col("from_url")), 256).alias("node"), F.col("to_url").alias("to"), "from_url")
        outside = logged.select("from_url").unionByName(logged.select(F.col("to").alias("from_url")))
        links = links.unionByName(logged.select("node", "to"))
    else:
        outside = links.select(F.col("to").alias("from_url"))
    links = links.select(F.col("node").alias("a"), F.sha2(node_of(F.col("to")), 256).alias("b")).where("a is not null and b is not null")
    if redirects is not None:
        outside = outside.unionByName(slim.select(F.explode("targets").alias("from_url")))
    named = F.col("from_url")
    outside = outside.where(F.instr(named, "://") > 0).select(
        F.sha2(node_of(named), 256).alias("node"), host_of(named).alias("host"), path_of(named).alias("path"), F.lit(0).alias("rows")
    )
    known = slim.where("node is not null").select("node", "host", "path", F.lit(1).alias("rows")).unionByName(outside)
    # one node for all its rows: /  and the empty path are one node but fit other rules, so both stay
    nodes = known.groupBy("node", "host", "path").agg(F.sum("rows").cast("long").alias("rows"))
    nodes = materialize(nodes.withColumn("id", F.concat("node", F.when(F.col("path") == "", F.lit("-")).otherwise(F.lit("/")))), "url-nodes")
    judged = fitting_rules(nodes.select(F.col("id").alias("node"), "host", "path"), rules).withColumnRenamed("node", "id")
    judged = materialize(nodes.join(judged, "id", "left").select("id", "node", "rows", "rule", "rule_verdict"), "url-judged")

    classes = components(links, "url-classes").withColumnRenamed("id", "node")
    blocked = F.max((F.col("rule_verdict") == "block").cast("int"))
    classes = materialize(classes.join(judged.select("node", "rule_verdict"), "node", "left").select("node", "component_id", "rule_verdict"), "url-members")
    shut = classes.groupBy("component_id").agg(blocked.alias("shut")).where("shut = 1").select("component_id")
    shut = classes.join(shut, "component_id", "left_semi").select("node")
    shut = shut.unionByName(judged.where("rule_verdict = 'block'").select("node")).distinct().withColumn("shut", F.lit(True))
    by_alias = F.when(F.col("shut"), F.lit("block")).otherwise(F.lit("allow"))
    verdicts = judged.where("rows > 0").join(shut, "node", "left")
    verdicts = verdicts.select("id", "rows", "rule", F.coalesce("rule_verdict", by_alias).alias("verdict"))
    verdicts = materialize(verdicts, "url-verdicts")

    # a URL with many rows is sent to them, the others meet their rows by key
    hot = F.col("rows") * HOT_PARTS > n_rows
    own = slim.withColumn("id", F.concat("node", F.when(F.col("path") == "", F.lit("-")).otherwise(F.lit("/")))).drop("targets", "node")
    crowded = F.broadcast(verdicts.where(hot).select("id", F.col("rule").alias("h_rule"), F.col("verdict").alias("h_verdict")))
    own = own.join(crowded, "id", "left")
    met = own.where("h_verdict is not null").select("row", "host", "path", F.col("h_rule").alias("rule"), F.col("h_verdict").alias("verdict"))
    rest = own.where("h_verdict is null").join(verdicts.where(~hot), "id", "left").select("row", "host", "path", "rule", "verdict")
    return met.unionByName(rest).select(
        "row.*",
        F.col("host").alias("_host"),
        F.col("path").alias("_path"),
        F.col("rule").alias("_rule"),
        F.coalesce("verdict", F.lit("allow")).alias("_verdict"),
    )
