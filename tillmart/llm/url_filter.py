"""URL filter: rules for hosts and paths, and link-graph propagation for what no rule covers.

Hosts with pages that a rule allows are seeds of trust, hosts with pages that a rule blocks are
seeds of distrust, each by its number of such pages. Personalised PageRank carries trust along
links between hosts and distrust against them: who links to a blocked host is suspect. Both are
counted in pages (a kind's mass times the pages that seeded it), and a host's unruled pages are
neutral. A host is blocked when more than a set share of the three is distrust.

Links are summed per pair of hosts with a map-side combine before anything is joined, so a host
with a third of all pages is as many rows as it has neighbours. Both propagations run in one
stacked table; each round is written to the shared folder and the round before is removed.
"""

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.llm.common import lower_ascii
from tillmart.operators.staging import remove_path, stage

DAMPING = 0.85
TOLERANCE = 1e-6
DISTRUST_SHARE = 0.5


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of rule and verdict, null where none fits; of rules of equal length one that blocks goes first."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    choices = []
    for rule in sorted(rules, key=lambda rule: (-len(rule.host + rule.path), rule.verdict != "block", rule)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        choices.append(F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*choices, none)


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """src, dst, n: absolute links of pages to other hosts; links inside a host say nothing about others."""
    absolute = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), 1)
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(absolute).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), F.col("link"))).otherwise(F.col("link")))
    links = links.select("src", dst.alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank per kind. seeds: kind, host, weight; links: kind, src, dst, n. Result: kind, host, mass; masses of a kind add up to 1.

    What reaches a host without links returns to the seeds. Rounds go on until the masses change by
    less than the tolerance in all; damping shrinks the change each round, so that ends (about 90
    rounds by default). An error is raised where fewer are allowed and do not suffice.
    """
    if not 0 <= damping < 1:
        raise ValueError(f"damping {damping} is not in [0, 1)")
    spark = seeds.sparkSession
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = stage(seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("share")), "seeds")
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = stage(links.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("part")), "edges")
    mass = stage(start.select("kind", "host", F.col("share").alias("mass")), "mass")
    for done_rounds in itertools.count(1):
        moved = mass.join(edges, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("part")).alias("moved"))
        moved = stage(moved, "moved")
        carried = {row.kind: row.moved for row in moved.groupBy("kind").agg(F.sum("moved").alias("moved")).collect()}  # two kinds
        back = F.lit(1.0)
        for kind, total in carried.items():
            back = F.when(F.col("kind") == kind, F.lit(1 - damping * total)).otherwise(back)
        parts = start.select("kind", "host", (F.col("share") * back).alias("mass")).unionByName(
            moved.select("kind", "host", (F.col("moved") * damping).alias("mass"))
        )
        new = stage(parts.groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "mass")
        change = new.unionByName(mass.select("kind", "host", (-F.col("mass")).alias("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        moved_by = change.agg(F.sum(F.abs("mass"))).first()[0] or 0.0
        for done in (mass, moved):
            for path in {file.rsplit("/", 1)[0] for file in done.inputFiles()}:
                remove_path(spark, path)
        mass = new
        if moved_by < tolerance:
            return mass
        if done_rounds == rounds:
            raise RuntimeError(f"after {rounds} rounds masses still change by {moved_by}")


def judge_pages(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    damping: float = DAMPING, rounds: int | None = None, distrust_share: float = DISTRUST_SHARE,
) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, trust, distrust.

    A null url or one without `://` has an empty host and path and is allowed, as is a host that
    neither trust nor distrust reaches. A page that no rule covers is one neutral page of its host. Null html has no links. Repeated rows are judged alike
    and count as often as they occur; an empty table gives an empty result; other columns play
    no part.
    """
    judged = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
    judged = judged.select("id", "host", "path", F.col("ruled.rule").alias("rule"), F.col("ruled.verdict").alias("by_rule"))

    counts = stage(judged.groupBy(F.col("by_rule").alias("kind"), "host").agg(F.count(F.lit(1)).alias("weight")), "host-pages")
    seeds = counts.where("kind IS NOT NULL")
    pages_of = {row.kind: row.weight for row in seeds.groupBy("kind").agg(F.sum("weight").alias("weight")).collect()}  # two kinds
    links = stage(host_links(pages, url_col, html_col), "links")
    stacked = links.select(F.lit("allow").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    mass = propagate(seeds, stacked, damping, rounds)
    sides = {kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)) for kind in ("allow", "block")}
    parts = mass.select("kind", "host", "mass", F.lit(0).cast("bigint").alias("neutral")).unionByName(
        counts.where("kind IS NULL").select("kind", "host", F.lit(0.0).alias("mass"), F.col("weight").alias("neutral"))
    )
    hosts = stage(parts.groupBy("host").agg(sides["allow"].alias("trust"), sides["block"].alias("distrust"), F.sum("neutral").alias("neutral")), "host-scores")
    good, bad = (F.col(side) * F.lit(pages_of.get(kind, 0)) for side, kind in (("trust", "allow"), ("distrust", "block")))
    # Rounded, so that the last bit of a quotient decides no tie.
    blocked = F.round(bad - distrust_share * (good + bad + F.col("neutral")), 6) > 0
    return judged.join(hosts, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
