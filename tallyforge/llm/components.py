"""Connected components of a graph whose links lie in a DataFrame.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014). Each step groups by node with partial sums; what it leaves is written to the
shared folder. Steps end as soon as each node but the least of its component has one link, to that
one, which a count by node tells; no step is run to see that it changes nothing, as plans and their
updates take the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above u goes to the least node among u and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour below u, and u, goes to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_done(links: DataFrame) -> bool:
    """Whether each node above others has one link, to a node that has none to a lesser one; links go from u down to v."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(links: DataFrame, name: str = "components", most_steps: int = 60) -> DataFrame:
    """(node, component) for each node of links(u, v): component is the least node that it reaches.

    Null ends and loops link nothing; repeated links count once. An empty graph gives an empty table.
    """
    a, b = (F.col(c).cast("long") for c in links.columns[:2])
    kept = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}-links")
    steps = 0
    while not _is_done(kept):
        if steps == most_steps:
            raise RuntimeError(f"components: not done after {most_steps} steps")
        kept, steps = stored(_small_star(_large_star(kept)), f"{name}-step"), steps + 1
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
