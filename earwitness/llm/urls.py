"""URL filter: rules by host and path, and link-graph propagation for what no rule fits.

Trust starts at hosts with allowed pages and flows along links; distrust starts at
hosts with blocked pages and flows against them. Both are personalised PageRanks
over the graph of host edges, and every host is blocked where its distrust is the
larger by a threshold. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Link targets of a page: the href of its anchors.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class RankParams:
    """Damping of both PageRanks; a host is blocked above ``ratio`` times its trust, beyond a share of ``margin``.

    Verdicts come from ranks that were propagated until no host's changed by more
    than the share ``tolerance`` in a round, which leaves an error below ``margin``.
    ``rounds`` and ``digits`` are of ranks after a fixed number of rounds.
    """

    damping: float = 0.85
    rounds: int = 10
    ratio: float = 1.0
    digits: int = 12
    cut_every: int = 4
    tolerance: float = 1e-6
    margin: float = 1e-5


PARAMS = RankParams()


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` of links between different hosts, once each."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))).alias("href"))
    full = links.select("host", F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href")).alias("href"))
    return full.select(F.col("host").alias("src"), host_of(F.col("href")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def personalised_rank(edges: DataFrame, seeds: DataFrame, params: RankParams = PARAMS, tolerance: float | None = None) -> DataFrame:
    """``host``, ``rank`` of PageRank over ``edges`` (src, dst) that restarts at ``seeds`` (host, seed; the seeds sum to 1).

    What reaches a host without edges is not dealt out again, which scales all
    ranks alike. Ranks travel in equi-joins and map-side sums; lineage is cut by
    reliable checkpoints.

    With a ``tolerance`` there are as many rounds as it takes until the largest
    relative change is within it, and nothing is rounded; a host first reached
    counts as changed, so every host within reach of a seed has a rank. The largest
    relative change never grows from round to round, since ranks and changes take
    the same ways. Without, there are ``params.rounds`` rounds, and ranks are rounded.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = cut_lineage(edges.join(out, "src").select("src", "dst", (F.lit(params.damping) / F.col("degree")).alias("w")))
    restart = seeds.select("host", ((1 - params.damping) * F.col("seed")).alias("rank"))
    rank = restart
    if weighted.isEmpty():
        return rank
    for k in count() if tolerance is not None else range(params.rounds):
        moved = weighted.join(rank.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("w") * F.col("rank")).alias("rank"))
        if tolerance is not None and k % params.cut_every == params.cut_every - 1:
            old = rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
            both = restart.union(moved).withColumn("old", F.lit(0.0)).union(old)
            after = cut_lineage(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")))
            rank = after.select("host", "rank")
            change = after.where("rank > 0").agg(F.max(F.abs(F.col("rank") - F.col("old")) / F.col("rank"))).first()[0]
            if change is None or change <= tolerance:
                return rank
            continue
        rank = restart.union(moved).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % params.cut_every == params.cut_every - 1:
            rank = cut_lineage(rank)
    return rank.select("host", F.round("rank", params.digits).alias("rank"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], keep: Sequence[str] = ("page_id",), params: RankParams = PARAMS) -> DataFrame:
    """Per row of ``pages`` (``url``, ``html``): ``keep``, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (verdict, host/path) pairs. A rule fits its host and all
    subdomains, if the path of the url starts with the rule's; the longest fitting
    one decides, and of equal ones the first. All other rows get the verdict of
    their host from the link graph: ``block`` where distrust exceeds ``ratio``
    times trust, else ``allow``. Null or odd urls have an empty host and are
    allowed. Pages of one host meet its row in a join that AQE can split.
    """
    spark = pages.sparkSession
    book = spark.createDataFrame(
        [(k, text.partition("/")[0], "/" + text.partition("/")[2], text, verdict) for k, (verdict, text) in enumerate(rules)],
        "place int, domain string, prefix string, rule string, rule_verdict string")
    placed = pages.select(*keep, "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fits = placed.select("host").distinct().select("host", F.explode(F.array_distinct(_suffixes(F.col("host")))).alias("domain")).join(book, "domain")
    order = F.struct((-F.char_length("rule")).alias("length"), "place", "prefix", "rule", "rule_verdict")
    own = cut_lineage(fits.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("rules")))
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r.prefix))
    ruled = placed.drop("html").join(own, "host", "left").withColumn("found", F.try_element_at(fitting, F.lit(1)))

    counts = ruled.where("found is not null").groupBy("host").agg(
        F.sum(F.when(F.col("found.rule_verdict") == "allow", 1).otherwise(0)).alias("allowed"), F.count("*").alias("n"))
    shares = cut_lineage(counts.select("host", (F.col("allowed") / F.col("n")).alias("good"), (1 - F.col("allowed") / F.col("n")).alias("bad")))
    sums = shares.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    edges = cut_lineage(host_edges(placed))
    trust = personalised_rank(edges, shares.where("good > 0").select("host", (F.col("good") / F.lit(sums.good or 1.0)).alias("seed")), params, params.tolerance)
    distrust = personalised_rank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), shares.where("bad > 0").select("host", (F.col("bad") / F.lit(sums.bad or 1.0)).alias("seed")), params, params.tolerance)
    known = trust.select("host", "rank", F.lit(0.0).alias("against")).union(distrust.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("against")))
    bad = known.groupBy("host").agg(F.sum("rank").alias("trust"), F.sum("against").alias("distrust")).where(F.col("distrust") > F.col("trust") * (params.ratio * (1 + params.margin))).select("host", F.lit(True).alias("bad"))
    return ruled.join(bad, "host", "left").select(
        *keep, "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.rule_verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
