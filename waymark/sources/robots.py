"""robots.txt as relations: groups, rules, delays and sitemaps, and who may fetch what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.config import LIMITS
from waymark.functions.text import trim

#: The agent that rules are read for, unless a caller names another.
AGENT = "waymark/0.1"


def lines(texts: DataFrame) -> DataFrame:
    """``site, line_no, field, value, group_no``: directives; agents in a row open one group."""
    raw = texts.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line_no", "raw"))
    line = trim(F.regexp_replace("raw", "#.*$", ""))
    field = F.lower(trim(F.regexp_extract(line, "^([^:]*):", 1)))
    value = trim(F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1))
    rows = raw.filter(line.contains(":")).select("site", "line_no", field.alias("field"), value.alias("value"))
    order = Window.partitionBy("site").orderBy("line_no")
    agent = F.col("field") == "user-agent"
    # Sitemap lines stand outside of groups and neither open nor close one.
    inner = rows.filter("field <> 'sitemap'").withColumn("opens", agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False)))
    grouped = inner.withColumn("group_no", F.sum(F.col("opens").cast("int")).over(order)).drop("opens")
    return grouped.unionByName(rows.filter("field = 'sitemap'").withColumn("group_no", F.lit(None).cast("long")))


def sitemaps(directives: DataFrame) -> DataFrame:
    """``site, ord, url`` of the declared sitemaps."""
    order = F.row_number().over(Window.partitionBy("site").orderBy("line_no")) - 1
    return directives.filter("field = 'sitemap'").select("site", order.alias("ord"), F.col("value").alias("url"))


def _named(directives: DataFrame, agent: str) -> DataFrame:
    """``site, name``: the longest name that is part of ours or holds it, else the wildcard."""
    ours = agent.lower()
    names = directives.filter("field = 'user-agent'").select("site", F.lower("value").alias("name"), "line_no").groupBy("site", "name").agg(F.min("line_no").alias("first"))
    fits = F.lit(ours).contains(F.col("name")) | F.col("name").contains(ours)
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.col("name") == "*", F.length("name").desc(), "first"))
    return names.filter(fits | (F.col("name") == "*")).withColumn("n", rank).filter("n = 1").select("site", "name")


def _of_group(directives: DataFrame, agent: str) -> DataFrame:
    """Directives of every group that has the chosen name, in order."""
    named = _named(directives, agent)
    groups = directives.filter("field = 'user-agent'").select("site", "group_no", F.lower("value").alias("name")).join(named, ["site", "name"]).select("site", "group_no").distinct()
    return directives.filter("field <> 'user-agent' AND group_no > 0").join(groups, ["site", "group_no"])


def rules(directives: DataFrame, agent: str = AGENT) -> DataFrame:
    """``site, rule_ord, allow, path, pattern``; a disallow without a path forbids nothing."""
    own = _of_group(directives, agent).filter("field IN ('allow', 'disallow') AND NOT (field = 'disallow' AND value = '')")
    order = F.row_number().over(Window.partitionBy("site").orderBy("line_no")) - 1
    return own.select("site", order.alias("rule_ord"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), rule_pattern(F.col("value")).alias("pattern"))


def delays(directives: DataFrame, agent: str = AGENT) -> DataFrame:
    """``site, delay_ms``: the last valid delay of our group, capped."""
    seconds = F.col("value").try_cast("double")
    own = _of_group(directives, agent).filter((F.col("field") == "crawl-delay") & (seconds >= 0))
    return own.groupBy("site").agg(F.max_by(F.least(seconds * 1000, F.lit(float(LIMITS.robots_delay_ms))), "line_no").alias("delay_ms"))


def rule_pattern(path: Column) -> Column:
    """A rule as a regular expression: * is any run, $ at the end is the end."""
    body = F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(path.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def allowed(urls: DataFrame, site_rules: DataFrame, path: str = "path") -> DataFrame:
    """``urls`` (with site and path) and whether each may be fetched: the longest fitting rule decides,
    an allowing one on a tie; without any, yes. A site's rules are gathered into one row, so a
    candidate meets them without being multiplied."""
    gathered = site_rules.filter("path <> ''").groupBy("site").agg(F.collect_list(F.struct(F.length("path").alias("n"), "allow", "pattern")).alias("rules"))
    fitting = F.filter("rules", lambda r: F.regexp_like(F.col(path), r["pattern"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["n"], r["allow"].alias("allow"))))
    return urls.join(gathered, "site", "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules")
