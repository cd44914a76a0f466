"""URL filter by path-template trees.

Every host has a tree of path segments. From the root down, level by level: a node with many
different, mostly rare children generalises them into a wildcard ``*``; children whose
behaviour does not differ statistically from their siblings' (how often the path ends there,
how often labelled pages below are blocked; Hoeffding bounds) merge into one branch ``~``;
all others keep their segment. A node's purity is the share of blocked pages among its
labelled ones, smoothed towards its parent's and, at the top, towards the share of all
hosts. Templates whose purity reaches the limit are rejected. Explicit rules go first, and
the pages they decide are the labels.

All of it is DataFrame work on counts per path: pages are grouped once, every level is
grouped and joined by node.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


@dataclass(frozen=True)
class TreeSettings:
    depth: int = 12  # segments beyond it share one wildcard
    wide: int = 16  # a node with so many different children ...
    variety: float = 0.5  # ... at least so many for each page is variable
    alpha: float = 0.05  # error level of the similarity test
    weight: float = 4.0  # labelled pages that the parent's purity counts for
    limit: float = 0.5  # purity from which a template is rejected


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @classmethod
    def of(cls, text: str, block: bool) -> Rule:
        host, slash, rest = text.partition("/")
        return cls(host, slash + rest, block)

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null; block wins a tie."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.block)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        verdict = "block" if rule.block else "allow"
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def path_templates(paths: DataFrame, s: TreeSettings = TreeSettings()) -> DataFrame:
    """Template and purity of each path.

    Takes one row per (host, path) with n pages, of which nl are labelled and nb blocked.
    Returns host, path, template, purity. Segments are what stands between slashes; empty
    ones do not count.
    """
    spark = paths.sparkSession
    whole = paths.agg(F.sum("nl").alias("nl"), F.sum("nb").alias("nb")).first()
    overall = ((whole["nb"] or 0) + s.weight * 0.5) / ((whole["nl"] or 0) + s.weight)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = paths.select("host", "path", "n", "nl", "nb", segments.alias("parts"))
    hosts = rows.groupBy("host").agg(F.sum("nl").alias("hl"), F.sum("nb").alias("hb"))
    rows = rows.join(hosts, "host").select(
        "host", "path", "n", "nl", "nb", "parts", F.lit("").alias("node"),
        ((F.col("hb") + s.weight * overall) / (F.col("hl") + s.weight)).alias("purity"),
    )
    rows, path = stage(rows, "url-level")
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    bound = F.lit(0.5 * log(2 / s.alpha))
    for level in range(min(deepest, s.depth)):
        has = F.size("parts") > level
        segment = F.when(F.lit(level == s.depth - 1), F.lit("**")).otherwise(F.get("parts", F.lit(level)))
        below = rows.where(has).withColumn("segment", segment)
        ends = F.when(F.size("parts") == level + 1, F.col("n")).otherwise(0)
        children = below.groupBy("host", "node", "segment", "purity").agg(
            F.sum("n").alias("n"), F.sum(ends).alias("ends"), F.sum("nl").alias("nl"), F.sum("nb").alias("nb"))
        totals = children.groupBy("host", "node").agg(
            F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("tn"), F.sum("ends").alias("te"),
            F.sum("nl").alias("tl"), F.sum("nb").alias("tb"))
        both = children.join(totals, ["host", "node"])

        def alike(hits: Column, n: Column, all_hits: Column, all_n: Column) -> Column:
            gap = F.abs(hits / n - all_hits / all_n)
            near = gap <= F.sqrt(bound) * (1 / F.sqrt(n) + 1 / F.sqrt(all_n))
            return F.coalesce(near, F.lit(True))  # nothing labelled: no difference shown

        variable = (F.col("kinds") >= s.wide) & (F.col("kinds") >= s.variety * F.col("tn"))
        positive = F.when(F.col("nl") > 0, F.col("nl")), F.when(F.col("tl") > 0, F.col("tl"))
        similar = alike(F.col("ends"), F.col("n"), F.col("te"), F.col("tn")) & alike(
            F.col("nb"), positive[0], F.col("tb"), positive[1])
        # A single child has no siblings to merge with.
        name = F.when(variable, F.lit("*")).when(similar & (F.col("kinds") > 1), F.lit("~")).otherwise(F.col("segment"))
        named = both.select("host", "node", "segment", "purity", "nl", "nb", F.concat("node", F.lit("/"), name).alias("child"))
        merged = named.groupBy("host", "node", "child", "purity").agg(F.sum("nl").alias("cl"), F.sum("nb").alias("cb"))
        merged = merged.select("host", "node", "child",
                               ((F.col("cb") + s.weight * F.col("purity")) / (F.col("cl") + s.weight)).alias("child_purity"))
        step = named.select("host", "node", "segment", "child").join(merged, ["host", "node", "child"])
        rest = rows.where(~has).select("host", "path", "n", "nl", "nb", "parts", "node", "purity")
        moved = below.join(step, ["host", "node", "segment"]).select(
            "host", "path", "n", "nl", "nb", "parts", F.col("child").alias("node"), F.col("child_purity").alias("purity"))
        following, following_path = stage(rest.union(moved), "url-level")
        discard(spark, path)
        rows, path = following, following_path
    return rows.select("host", "path", F.col("node").alias("template"), "purity")


def judge_urls(pages: DataFrame, rules: list[Rule], settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Verdict on every page's url: page_id, host, path, rule, verdict, template, purity.

    The longest fitting rule decides; without one the path's template does. A null url and
    one without ``://`` have an empty host and path and are judged like any other host.
    Repeated rows stay and count as often as they occur; other columns are ignored; an empty
    table gives an empty result. ``rules`` are part of the query, not data.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(url).alias("host"),
                        F.when(url.contains("://"), url_path(url)).otherwise("").alias("path"))
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    # Rules look at host and path only, so they are applied once per path.
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("r", ruled)
    paths = paths.withColumn("nl", F.when(F.col("r").isNull(), 0).otherwise(F.col("n"))).withColumn(
        "nb", F.when(F.col("r.verdict") == "block", F.col("n")).otherwise(0))
    templates = path_templates(paths, settings)
    judged = rows.join(templates, ["host", "path"]).withColumn("r", ruled)
    by_tree = F.when(F.col("purity") >= settings.limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                         F.coalesce(F.col("r.verdict"), by_tree).alias("verdict"), "template", "purity")
