"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import released, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every node of ``edges``; the component is its smallest id.

    Each round points every node's larger neighbours, then its smaller ones, at
    the smallest node it sees. Rounds grow with the logarithm of the longest
    path; each is a pair of keyed minimums, pre-aggregated before the shuffle,
    and joins on node ids whose large keys adaptive execution splits. It ends when a
    round has changed no link, by comparison of the links themselves. Loops,
    repeated edges and nulls are left out; no edges give no rows.
    """
    links = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(lowest, "u")
            .where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(least, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, links = links, written(small_star)
        # sets of one size of which none has a link that the other lacks are equal: nothing moved
        settled = before.count() == links.count() and before.join(links, ["u", "v"], "left_anti").isEmpty()
        released(before)
        if settled:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
