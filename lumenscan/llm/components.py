"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.session import write_stage


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _to_smallest(edges: DataFrame) -> DataFrame:
    """Each node u with its neighbours v and the smallest of u and them, m."""
    smallest = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(smallest, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component, for every node of ``edges`` (u, v) that is not a root.

    Alternating star contraction. In a round every node first passes its larger neighbours to
    its smallest one, then its smaller neighbours; edges never grow in number and long chains
    halve. Minima are summed on the map side and only the narrow edge table is shuffled. Each
    round is written to the shared folder, so neither lineage nor lost executors repeat earlier
    rounds. It ends when a round changes nothing: every component is then a star.
    """
    now = write_stage(edges.filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "edges")
    before = _summary(now)
    while before[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_smallest(large)
        passed = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = write_stage(passed.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _summary(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
