"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.staging import staged


def _least(edges: DataFrame, name: str) -> DataFrame:
    """(u, v), both ways or not -> per u: m, the least of u and its neighbours; open, whether u keeps the graph from being a star forest.

    In a star forest no node has two lesser neighbours, or lesser and greater ones.
    All of this is one grouping with partial sums, so a hub's edges never meet.
    """
    lesser, greater = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
    return staged(edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), ((lesser > 1) | ((lesser > 0) & (greater > 0))).alias("open")), name)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of an edge.

    Self loops keep a lone node in the result. Null ends are ignored; an empty
    table gives an empty result. Nodes may be of any one orderable type. Each
    round is four joins or groupings on the edge's ends and is staged; star
    contraction needs a number of rounds logarithmic in the longest chain.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = given.select("u").union(given.select("v"))
    given = staged(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now = given
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        least = _least(both, "star")
        if least.where("open").isEmpty():
            break
        # The minima are staged, so both join sides are plain scans behind an exchange, which adaptive execution can split.
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = large.join(_least(large, "star"), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "small")
    else:
        raise RuntimeError("components did not converge")
    ends = now.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.distinct().join(ends, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def chain_ends(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """a, b with every chain a -> b -> ... followed to its end, by pointer doubling. Each a has one b; there are no rings."""
    now = staged(links.select(a, b), "chains")
    for _ in range(max_rounds):
        ahead = now.select(F.col(a).alias(b), F.col(b).alias("__next"))
        now = staged(now.join(ahead, b, "left").select(a, F.coalesce("__next", b).alias(b), F.col("__next").isNotNull().alias("moved")), "chains")
        if now.where("moved").isEmpty():
            return now.select(a, b)
        now = now.select(a, b)
    raise RuntimeError("the chains have no end")
