"""URL filters: rules by host and path, and a verdict from the link graph where no rule fits.

Trust starts at hosts with allowed pages and follows links (personalised PageRank). Distrust
starts at hosts with blocked pages and follows links backwards, to the hosts that link there. A
host with more distrust than ``threshold`` times its trust is blocked.

All of it is DataFrame functions. Links are aggregated to weighted host edges before the first
shuffle, so a host with a third of all pages sends its edges once per task; the iterations work
on hosts and edges only. Each iteration joins and aggregates both walks at once, and lineage is
cut by a written table every few iterations.

Besides links to absolute targets, a host and its parent domain count as linked both ways.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.session import fresh_dir

DAMPING = 0.85
ITERATIONS = 12
CUT_EVERY = 4
#: How many times its trust a host's distrust must be to block it.
THRESHOLD = 3.0
#: Weight of the edge between a host and its parent domain; a link from one page weighs 1.
KIN_WEIGHT = 1.0


class UrlRule(NamedTuple):
    """``pattern`` is ``host/path``: the host with its subdomains, and how the path begins."""

    verdict: str
    pattern: str


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; ``""`` without."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits; of equal ones the first; else null."""
    pattern = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.pattern)):
        name, slash, start = rule.pattern.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        pattern = F.when(fits, F.lit(rule.pattern)) if pattern is None else pattern.when(fits, F.lit(rule.pattern))
        verdict = F.when(fits, F.lit(rule.verdict)) if verdict is None else verdict.when(fits, F.lit(rule.verdict))
    return (pattern, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links between different hosts in ``html``, by absolute targets."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""), 1)
    found = pages.select("host", F.explode(links).alias("url"))
    target = host_of(F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url")))
    edges = found.select(F.col("host").alias("src"), target.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def kin_edges(hosts: DataFrame, weight: float = KIN_WEIGHT) -> DataFrame:
    """``src, dst, weight`` between each host and its parent domain, both ways, up to two labels.

    Hosts of one site vouch for each other even where pages hold relative links only.
    """
    labels = F.split("host", r"\.")
    names = hosts.select("host").distinct().where(F.size(labels) > 2).select(F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), ".")).alias("chain"))
    pairs = names.select(F.explode(F.arrays_zip(F.expr("slice(chain, 1, size(chain) - 1)").alias("low"), F.expr("slice(chain, 2, size(chain) - 1)").alias("high"))).alias("p")).select("p.low", "p.high").distinct()
    ends = F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")), F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))
    return pairs.select(F.explode(ends).alias("e")).select("e.src", "e.dst", F.lit(float(weight)).alias("weight"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    folder = fresh_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def propagate(seeds: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` for every host in ``seeds`` (``host, good, bad``) or ``edges``.

    ``good`` and ``bad`` are non-negative seed weights, scaled to 1 in all. What a host without
    a link onwards would pass on is dropped.
    """
    one_way = edges.select("src", "dst", "weight", F.lit(True).alias("forward"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(False).alias("forward"))
    both = one_way.unionByName(back)
    out = both.groupBy("src", "forward").agg(F.sum("weight").alias("all"))
    steps = _stored(both.join(out, ["src", "forward"]).select("src", "dst", "forward", (F.col("weight") / F.col("all")).alias("share")), "url-edges")
    hosts = seeds.select("host", "good", "bad").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad")))
    base = _stored(hosts.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-hosts")
    good, bad = base.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    base = base.select("host", (F.col("good") / (good or 1.0)).alias("good"), (F.col("bad") / (bad or 1.0)).alias("bad"))
    ranks = base.select(F.col("host").alias("src"), F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for n in range(1, iterations + 1):
        forward = F.col("forward")
        moved = steps.join(ranks, "src").groupBy(F.col("dst").alias("host")).agg(
            F.sum(F.when(forward, F.col("trust") * F.col("share"))).alias("t"),
            F.sum(F.when(~forward, F.col("distrust") * F.col("share"))).alias("d"),
        )
        ranks = base.join(moved, "host", "left").select(
            F.col("host").alias("src"),
            ((1 - damping) * F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.col("bad") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        if n % CUT_EVERY == 0 or n == iterations:
            ranks = _stored(ranks, "url-ranks")
    return ranks.withColumnRenamed("src", "host")


def judge(pages: DataFrame, rules: Sequence[UrlRule], threshold: float = THRESHOLD, iterations: int = ITERATIONS) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``.

    Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and is
    allowed, as is a host that neither walk reaches. A null html has no links. Repeated rows stay
    and count as pages of their own. Other columns are ignored. Empty tables give empty results.
    """
    url = F.col("url").cast("string")
    given = pages.select("page_id", F.col("html").cast("string").alias("html"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = given.withColumns({"rule": rule, "by_rule": verdict})
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.sum(F.when(F.col("by_rule") == "allow", 1.0).otherwise(0.0)).alias("good"),
        F.sum(F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0)).alias("bad"),
    )
    edges = host_edges(given).unionByName(kin_edges(given.where("host <> ''"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    ranks = propagate(seeds, _stored(edges, "url-links"), iterations).withColumnRenamed("host", "_host")
    joined = ruled.drop("html").join(ranks, F.col("host") == F.col("_host"), "left")
    blocked = F.coalesce((F.col("distrust") > 0) & (F.col("distrust") > threshold * F.col("trust")), F.lit(False))
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(F.col("by_rule"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
