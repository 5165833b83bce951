"""9. URL filters by link-graph propagation, with DataFrame functions only.

Every page url is cut into host and path. Listed rules (host, path prefix) decide first: the
longest rule that fits wins. For the rest the host graph decides: personalised PageRank spreads
trust from hosts whose pages rules allow along the links between hosts, and distrust from hosts
whose pages rules block against the links (who links to bad hosts is suspect). Both walks run in
one table, each round a join of the weighted edges with the current mass and an aggregation by
host, until the mass has settled and no further host is reached; a host is blocked if its distrust
exceeds its trust.

Edges are counted per pair of hosts before they are shuffled, so a hot host costs one row per
neighbour. Mass and edges are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.llm.common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a walk has settled when a round changes less than this of the mass (each walk starts with 1); what
#: is then missing is at most ``damping / (1 - damping)`` times as much (under 6e-6)
TOLERANCE = 1e-6
#: an absolute link; its host ends as a url's does, or at the quote
LINK = r"""(?i)href\s*=\s*["']?[a-z][a-z0-9+.-]*+://([^/?#"'\s>]++)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, with A-Z lower-cased; the path from there up to ``?``, ``#`` or the end. A null url, or one
    without ``://``, has neither (both empty)."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def host_suffixes(host: Column) -> Column:
    """The host and the domains above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) of ``pages`` that a rule fits.

    ``rules(host, path, allow)``: a rule fits its host and all subdomains where the page's path
    starts with the rule's. The longest rule (host and path) wins; of equally long ones block,
    then the first in sorted order. Rules meet hosts by an equi-join on host suffixes.
    """
    where = pages.select("host", "path").distinct()
    hosts = where.select("host").distinct().where(F.col("host") != "")
    listed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "allow")
    fits = hosts.select("host", F.explode(F.array_distinct(host_suffixes(F.col("host")))).alias("suffix")).join(listed, "suffix")
    hit = where.join(fits, "host").where(F.col("path").startswith(F.col("prefix")))
    rule = F.concat("suffix", "prefix")
    best = F.max(F.struct(F.length(rule).alias("n"), (~F.col("allow")).alias("block"), rule.alias("rule")))
    return (hit.groupBy("host", "path").agg(best.alias("b"))
            .select("host", "path", F.col("b.rule").alias("rule"), F.when(F.col("b.block"), "block").otherwise("allow").alias("verdict")))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) over ``links(src, dst, n)`` from ``seeds(host, trust, distrust)``.

    ``seeds`` hold non-negative weights; each column is scaled to a total of 1 and returns to its
    seeds with probability ``1 - damping``. Links of a host to itself do not count. Mass at hosts
    without a way out is lost, which lowers all scores alike. Hosts without mass are left out. ``rounds`` sets a fixed number of rounds;
    without it they go on until a round reaches no further host and changes under ``TOLERANCE``.
    """
    edges = links.where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("n")))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    ways = materialize(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("w")))
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "m"))
    totals = start.groupBy("kind").agg(F.sum("m").alias("total")).where("total > 0")
    start = materialize(start.join(F.broadcast(totals), "kind")  # two rows
                        .select("kind", "host", (F.col("m") / F.col("total")).alias("m")).where("m > 0"))
    mass = start
    done = 0
    while done != rounds:
        moved = (mass.join(ways.withColumnRenamed("src", "host"), ["kind", "host"])
                 .select("kind", F.col("dst").alias("host"), (F.col("m") * F.col("w") * damping).alias("m")))
        back = start.select("kind", "host", (F.col("m") * (1 - damping)).alias("m"))
        step = moved.union(back).withColumn("was", F.lit(None).cast("double")).union(mass.select("kind", "host", F.lit(0.0), "m"))
        step = materialize(step.groupBy("kind", "host").agg(F.sum("m").alias("m"), F.sum("was").alias("was")))
        mass, done = step.drop("was"), done + 1
        if rounds is None:
            change = step.agg(F.sum(F.abs(F.col("m") - F.coalesce("was", F.lit(0.0)))).alias("mass"), F.count_if(F.col("was").isNull()).alias("hosts")).first()
            if not change["hosts"] and (change["mass"] or 0.0) <= TOLERANCE:
                break
    part = [F.sum(F.when(F.col("kind") == k, F.col("m")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    return mass.groupBy("host").agg(*part)


def judge_urls(pages: DataFrame, rules: DataFrame, rounds: int | None = None, damping: float = 0.85, ratio: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) per row of ``pages(page_id, url, html)``.

    A page without a rule is blocked if its host's distrust is above ``ratio`` times its trust; hosts
    that neither walk reaches are allowed, and so are pages without a host. Null html has no links;
    repeated rows are judged each for itself; empty tables give no rows.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = materialize(match_rules(parts, rules))
    links = (pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
             .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' AND src <> dst")
             .groupBy("src", "dst").agg(F.count("*").alias("n")))
    seeds = ruled.groupBy("host").agg(F.sum(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"),
                                      F.sum(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    spread = propagate(links, seeds, rounds, damping)
    judged = parts.join(ruled, ["host", "path"], "left").join(spread, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("verdict", F.when((F.col("host") != "") & (distrust > ratio * trust), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
