"""Random walks on item graphs, started from baskets; DataFrame fixed points of a given number of steps.

Walks are linear in their start, so callers may walk once from each item and add up, or from baskets.
Paths of ``path_betweenness`` end at the evidence and are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def moved(mass: DataFrame, edges: DataFrame) -> DataFrame:
    """One step: (id, item, s) along src -> dst."""
    x = mass.select("id", F.col("item").alias("src"), "s").join(edges, "src")
    return x.groupBy("id", F.col("dst").alias("item")).agg(F.sum(F.col("s") * F.col("w")).alias("s"))


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("id", "item").agg(F.sum("s").alias("s"))


def scaled(x: DataFrame, by: float) -> DataFrame:
    return x.withColumn("s", F.col("s") * by)


def restart_walk(start: DataFrame, edges: DataFrame, alpha: float, steps: int) -> DataFrame:
    """s <- alpha s P + (1 - alpha) start, ``steps`` times from nothing."""
    home = scaled(start, 1 - alpha)
    s = home
    for _ in range(steps - 1):
        s = added(scaled(moved(s, edges), alpha), home)
    return s


def basket_walk(start: DataFrame, edges: DataFrame, d: float, steps: int) -> DataFrame:
    """s <- d T s + (1 - d) start: mass at j goes to i by T_ij, against the direction of src -> dst."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return restart_walk(start, turned, d, steps)


def converged(start: DataFrame, edges: DataFrame, alpha: float, tolerance: float = 1e-5, batch: int = 5, most: int = 200) -> tuple[DataFrame, int]:
    """A restart walk until its total changes by ``tolerance`` of itself at most, and the steps taken.

    Every ``batch`` steps the state is written, which cuts its lineage, and one sum is read.
    """
    home = scaled(start, 1 - alpha)
    s, before, steps = home, None, 1
    while steps < most:
        for _ in range(batch):
            s = added(scaled(moved(s, edges), alpha), home)
        s, steps = cut(s), steps + batch
        total = s.agg(F.sum("s")).first()[0] or 0.0
        if before is not None and abs(total - before) <= tolerance * max(abs(total), 1e-300):
            break
        before = total
    return s, steps


def path_betweenness(evidence: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(id, item, s): share of the weight of paths from the evidence back to it that pass an item.

    ``edges`` are the weights W. Paths leave each evidence item once and end when they reach one, so
    its own out-edges count for the first step only. Forward and backward sums take ``steps`` terms.
    """
    ends = evidence.select("id", "item")
    first = moved(ends.withColumn("s", F.lit(1.0)), edges)
    free = lambda x: x.join(ends, ["id", "item"], "left_anti")
    forward, term = first, first
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    back = ends.withColumn("s", F.lit(1.0))
    reach = back
    for _ in range(steps - 1):
        term = moved(free(term), edges)
        forward = added(forward, term)
        back = free(moved(back, turned))
        reach = added(reach, back)
    through = first.join(reach.select("id", "item", F.col("s").alias("r")), ["id", "item"]).groupBy("id").agg(F.sum(F.col("s") * F.col("r")).alias("z"))
    both = free(forward).join(reach.select("id", "item", F.col("s").alias("r")), ["id", "item"]).join(through, "id")
    return both.select("id", "item", (F.col("s") * F.col("r") / F.col("z")).alias("s"))
