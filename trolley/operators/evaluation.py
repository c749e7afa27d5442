"""Metrics of recommendations over baskets, each one set-based job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Graph
from .ranking import additive_scores, least_popular, of_size, ranked, recommend, shuffled


def hits(reco: DataFrame, targets: DataFrame, asked: DataFrame) -> DataFrame:
    """basket, value: 1 if a recommendation is a target, for each basket of ``asked``."""
    found = reco.join(targets, ["basket", "item"], "left_semi").select("basket").distinct().withColumn("value", F.lit(1.0))
    return asked.select("basket").distinct().join(found, "basket", "left").select("basket", F.coalesce("value", F.lit(0.0)).alias("value"))


def rare_item_hit(items: DataFrame, edges: DataFrame | Graph, stats: DataFrame, n: int) -> DataFrame:
    """The n least popular items are hidden; candidates are less popular than all the rest."""
    items = of_size(items, n + 1)
    targets = least_popular(items, stats, n)
    evidence = items.join(targets, ["basket", "item"], "left_anti")
    return hits(recommend(evidence, edges, n, stats), targets, items)


def shuffled_hit(items: DataFrame, edges: DataFrame | Graph, n: int) -> DataFrame:
    """n items by the fixed shuffle are hidden."""
    items = of_size(items, n + 1)
    targets = shuffled(items, n)
    evidence = items.join(targets, ["basket", "item"], "left_anti")
    return hits(recommend(evidence, edges, n), targets, items)


def weighted_leave_one_out(items: DataFrame, edges: DataFrame | Graph, stats: DataFrame, n: int) -> DataFrame:
    """Each item is hidden in turn; hits weigh 1 - prior.

    Scores add over evidence, so those without an item are the basket's less that item's own edges:
    one scoring of the basket serves all of its parts. By the paths of a graph each part is scored in its task.
    """
    items = of_size(items, n + 1)
    if isinstance(edges, Graph):
        rest = items.join(items.select("basket", F.col("item").alias("sub")), "basket").where("item <> sub")
        return _weighted(items, edges.best(rest, n).select(F.struct("basket", F.col("sub").alias("hidden")).alias("basket"), "item", "score"), stats, n)
    whole = additive_scores(items, edges)
    out = items.select("basket", F.col("item").alias("hidden"))
    own = edges.select(F.col("src").alias("hidden"), F.col("dst").alias("item"), F.col("w").alias("own"))
    left = whole.join(out, "basket").join(own, ["hidden", "item"], "left").withColumn("score", F.col("score") - F.coalesce("own", F.lit(0.0)))
    seen = items.select("basket", "item", F.lit(True).alias("seen"))
    left = left.join(seen, ["basket", "item"], "left").where("seen is null or item = hidden")
    return _weighted(items, left.select(F.struct("basket", "hidden").alias("basket"), "item", "score"), stats, n)


def _weighted(items: DataFrame, parts: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """basket, value: the share of 1 - prior that is hit, from scores of each basket without one item."""
    out = items.select("basket", F.col("item").alias("hidden"))
    hit = ranked(parts, n).where("item = basket.hidden").select("basket.basket", "basket.hidden").withColumn("hit", F.lit(1.0))
    weight = 1 - F.col("prior")
    rows = out.join(hit, ["basket", "hidden"], "left").join(stats.select(F.col("item").alias("hidden"), "prior"), "hidden")
    return rows.groupBy("basket").agg((F.sum(weight * F.coalesce("hit", F.lit(0.0))) / F.sum(weight)).alias("value"))


def novelty(items: DataFrame, edges: DataFrame | Graph, stats: DataFrame, n: int, top: DataFrame) -> DataFrame:
    """Mean of (m - prior) / m over the n best; m is the mean of the highest priors (``top``, one row)."""
    items = of_size(items, n + 1)
    evidence = items.join(least_popular(items, stats, n), ["basket", "item"], "left_anti")
    best = recommend(evidence, edges, n)
    priors = best.join(stats.where("pop <> 0").select("item", "prior"), "item").crossJoin(F.broadcast(top))
    value = priors.groupBy("basket").agg(F.avg((F.col("m") - F.col("prior")) / F.col("m")).alias("value"))
    return items.select("basket").distinct().join(value, "basket", "left").select("basket", F.coalesce("value", F.lit(0.0)).alias("value"))


def mean_prior(reco: DataFrame, stats: DataFrame) -> DataFrame:
    """basket, value: how popular its recommendations are."""
    return reco.join(stats, "item").groupBy("basket").agg(F.avg("prior").alias("value"))


#: Metrics by name: items (basket, item), edges, stats, n, mean of the highest priors (one row) -> basket, value.
METRICS = {
    "rare_item_hit": lambda items, edges, stats, n, top: rare_item_hit(items, edges, stats, n),
    "shuffled_hit": lambda items, edges, stats, n, top: shuffled_hit(items, edges, n),
    "leave_one_out": lambda items, edges, stats, n, top: weighted_leave_one_out(items, edges, stats, n),
    "novelty": lambda items, edges, stats, n, top: novelty(items, edges, stats, n, top),
}


def evaluate(items: DataFrame, edges: DataFrame | Graph, stats: DataFrame, n: int, names: list[str] | None = None) -> DataFrame:
    """basket, metric, value: every metric over all baskets that are large enough for it, a job a metric."""
    from .statistics import mean_of_top_priors

    top, out = mean_of_top_priors(stats), None
    for name in names or METRICS:
        one = METRICS[name](items, edges, stats, n, top).select("basket", F.lit(name).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def performance_matrix(values: DataFrame, baskets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row a basket and a column a metric; baskets that were too small for it have zero."""
    names = list(names or METRICS)
    wide = values.groupBy("basket").pivot("metric", names).agg(F.first("value"))
    return baskets.select("basket").distinct().join(wide, "basket", "left").na.fill(0.0, names)


def mean_performance(metrics: dict[str, DataFrame], baskets: DataFrame) -> DataFrame:
    """metric, mean (baskets too small to judge count as zero), mean_eligible."""
    n = baskets.select("basket").distinct().agg(F.count("*").alias("n"))
    out = None
    for name, rows in metrics.items():
        one = rows.agg(F.sum("value").alias("s"), F.count("*").alias("k")).crossJoin(F.broadcast(n)).select(F.lit(name).alias("metric"), (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), F.try_divide("s", "k").alias("mean_eligible"))
        out = one if out is None else out.unionByName(one)
    return out
