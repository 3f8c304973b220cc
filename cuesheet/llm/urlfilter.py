"""URL filters: rules by host and path, and link-graph propagation for what the rules leave open.

Host edges come from the links of the pages. Trust spreads from hosts with allowed pages along the
edges, distrust from hosts with blocked pages against them, both as personalised PageRank over
DataFrames; a host is blocked if distrust is more than ``threshold`` of its total. Links to the own
host are no edges. Hosts that neither score reaches are allowed.

Defined results: host and path are empty for a null url or one without ``://``; such pages fall to the
method too, as the empty host, which sends and receives no edges. A null html has no links. Very long pages are searched whole; an empty table gives an empty one. Repeated rows are
judged one by one and weigh as often as they come. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.plans.session import stage

#: (verdict, host, path); the longest host and path that fit decide.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-9, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, ruling); the rules are a short list that becomes one expression."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = ruling = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        ruling = F.when(fits, verdict) if ruling is None else ruling.when(fits, verdict)
    missing = F.lit(None).cast("string")
    return parts.withColumn("rule", missing if rule is None else rule).withColumn("ruling", missing if ruling is None else ruling)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) over absolute and scheme-relative links between different hosts."""
    link = F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1)))
    links = pages.select(host_of(F.col("url")).alias("src"), link.alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return links.select("src", host_of(full).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) with score = (1 - damping) * seed + damping * sum of weighted scores, from score 0 on.

    ``seeds`` is (kind, host, seed), ``edges`` is (kind, src, dst, weight). What a step adds is what the step before
    added, sent along the edges, so only that is carried; a step shrinks it by the damping at least. It ends when what
    a kind adds, its L1 change, is below ``tolerance``: at most log(tolerance) / log(damping) steps, 128 by default, and a host
    within as many hops of a seed has a score. What is left out adds up to tolerance / (1 - damping) at most.
    Each step's rows are stored, so lineage does not grow."""
    added = stage(seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score")), "ranks")
    steps = [added]
    while not added.groupBy("kind").agg(F.sum("score").alias("change")).filter(F.col("change") >= tolerance).isEmpty():
        sent = added.withColumnRenamed("host", "src").join(edges, ["kind", "src"])
        added = stage(sent.groupBy("kind", F.col("dst").alias("host")).agg(
            (damping * F.sum(F.col("score") * F.col("weight"))).alias("score")), "ranks")
        steps.append(added)
    return reduce(DataFrame.unionByName, steps).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def host_scores(pages_ruled: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): each kind's seeds add up to one."""
    kind = F.when(F.col("ruling") == "allow", "trust").when(F.col("ruling") == "block", "distrust")
    counted = pages_ruled.filter("ruling is not null").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    totals = counted.groupBy("kind").agg(F.sum("n").alias("total"))
    # two rows at most
    seeds = stage(counted.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed")), "seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("weight"))
    backward = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("weight"))
    scores = propagate(seeds, stage(forward.unionByName(backward), "edges"), damping, tolerance)

    def of(name):
        return F.sum(F.when(F.col("kind") == name, F.col("score")).otherwise(0.0)).alias(name)

    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict)."""
    pages_ruled = ruled(pages, rules)
    scores = stage(host_scores(pages_ruled, stage(host_edges(pages), "links"), damping, tolerance), "hosts")
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return pages_ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruling", F.when(bad, "block").otherwise("allow")).alias("verdict"))
