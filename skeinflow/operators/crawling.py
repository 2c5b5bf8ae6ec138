"""What a crawler decides by: robots rules, forbidden routes, bodies seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinflow.functions.urls import like_pattern


def robots_rules(files: DataFrame, key: str, text: str, agents: list[str] | tuple[str, ...] = ("*",)) -> DataFrame:
    """(key, agent, rule, route, delay): rules of each robots file that hold for one of the agents.

    ``rule`` is allow, disallow or crawl-delay; a route is as written, a delay in seconds (null where it is no number).
    Names of headers and agents are compared without case.  Agent lines one after the other share the rules below them; the
    next agent line after a rule ends these.  Lines without a colon, null and empty files give nothing.
    """
    lines = files.select(F.col(key), F.posexplode(F.split(F.col(text), "\\r?\\n")).alias("i", "line")).where(F.col("line").contains(":"))
    body = F.trim(F.expr("substr(line, instr(line, ':') + 1)"))
    parts = lines.select(key, "i", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("header"), body.alias("body"))
    parts = parts.where(F.col("header").isin("user-agent", "allow", "disallow", "crawl-delay"))
    # a group of rules begins at an agent line that follows a rule
    order = Window.partitionBy(key).orderBy("i")
    is_agent = F.col("header") == "user-agent"
    begins = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    grouped = parts.withColumn("g", F.sum(begins.cast("int")).over(order))
    named = grouped.where(is_agent).select(key, "g", F.lower("body").alias("agent")).where(F.col("agent").isin(*[a.lower() for a in agents])).distinct()
    rules = grouped.where(~is_agent).join(named, [key, "g"])
    delay = F.when(F.col("header") == "crawl-delay", F.expr("try_cast(body as double)"))
    route = F.when(F.col("header") != "crawl-delay", F.col("body"))
    return rules.select(key, "agent", F.col("header").alias("rule"), route.alias("route"), delay.alias("delay"))


def forbidden(pages: DataFrame, rules: DataFrame, host: str = "host", path: str = "path", route: str = "route") -> DataFrame:
    """The pages whose path a rule of their host forbids: a prefix, with * for any run of characters; empty rules forbid
    nothing.  A page comes out once, however many rules match."""
    listed = rules.where(F.col(route) != "").select(host, F.concat(like_pattern(F.col(route)), F.lit("%")).alias("_like")).distinct()
    listed = listed.groupBy(host).agg(F.collect_set("_like").alias("_likes"))  # as many as its robots file has
    hit = F.exists("_likes", lambda p: F.call_function("like", F.col(path), p))
    return pages.join(listed, host).where(hit).select(*pages.columns)


def seen_before(pages: DataFrame, text: Column, order: list[str], url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, canonical): pages with a body that an earlier page of ``order`` (the last of its columns tells pages apart) has,
    and the address of the first.  What moves are digests; the first of a body is found with map-side combining."""
    each = pages.select(F.col(key), F.col(url), *[c for c in order if c not in (key, url)], F.md5(text.cast("binary")).alias("h")).where("h is not null")
    first = each.groupBy("h").agg(F.min(F.struct(*order, url)).alias("f")).select("h", F.col(f"f.{key}").alias("_first"), F.col(f"f.{url}").alias("canonical"))
    return each.select(key, "h").distinct().join(first, "h").where(F.col(key) != F.col("_first")).select(key, "canonical")
