"""Scores of items for baskets, and their order: score rounded to nine places, then the larger item first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Graph

#: Rows of a table that may be sent to every executor.
FEW = 2_000_000
#: Items of baskets whose paths make one task.
ITEMS_A_TASK = 1_000

def additive_scores(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """basket, item, score: the sum of edges from the basket's items."""
    x = evidence.select("basket", F.col("item").alias("src")).join(edges, "src")
    return x.groupBy("basket", F.col("dst").alias("item")).agg(F.sum("w").alias("score"))


def cooccurrence_scores(evidence: DataFrame, ui: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """basket, item, score: ``additive_scores`` over the co-occurrence graph, which is not built.

    A basket's items give it customers with a summed weight, and these give it items, so only paths from
    baskets are made. Where the counts are few rows they go to every executor, and a basket's paths stay in its
    task. With ``stats`` only ``novel`` items are scored: others are left out before they are summed.
    """
    few = ui.limit(FEW + 1).count() <= FEW
    small = F.broadcast if few else (lambda table: table)
    ends = ui.select("customer", F.col("item").alias("dst"), F.col("w").alias("b"))
    x = evidence.select("basket", "item")
    key = ["basket"]
    if stats is not None:
        pops = stats.select("item", "pop")
        x = x.join(pops, "item").withColumn("least", F.min("pop").over(Window.partitionBy("basket"))).drop("pop")
        ends, key = ends.join(pops.withColumnRenamed("item", "dst"), "dst"), ["basket", "least"]
    if few:  # a number of its own: paths are many more than the rows they start from, by which tasks would be merged
        tasks = max(int(ui.sparkSession.conf.get("spark.sql.shuffle.partitions")), evidence.count() // ITEMS_A_TASK)
        x = x.repartition(tasks, "basket")
    customers = x.join(small(ui), "item").groupBy(*key, "customer").agg(F.sum("w").alias("a"))
    paths = customers.join(small(ends), "customer")
    paths = paths if stats is None else paths.where("pop < least")
    return paths.groupBy("basket", F.col("dst").alias("item")).agg(F.sum(F.col("a") * F.col("b")).alias("score"))


def without_evidence(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    return scores.join(evidence.select("basket", "item"), ["basket", "item"], "left_anti")


def popularity_scores(evidence: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """The most popular items for each basket: enough of them to fill n places after evidence is left out.

    A basket of k items can lose k places at most, so only the n + k first are paired with it.
    """
    first = Window.partitionBy(F.lit(0)).orderBy(F.desc("pop"), F.desc("item"))
    sizes = evidence.groupBy("basket").agg(F.count("*").alias("k"))
    most = sizes.agg(F.max("k")).first()[0] or 0
    top = stats.orderBy(F.desc("pop"), F.desc("item")).limit(n + most).withColumn("place", F.row_number().over(first))
    pairs = sizes.join(F.broadcast(top), F.col("place") <= n + F.col("k"))  # n + most rows
    return without_evidence(pairs.select("basket", "item", F.col("pop").alias("score")), evidence)


def weight_scores(evidence: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """The size of the basket times the weight (item, w) of an item: enough items for each basket to fill n places.

    As in ``popularity_scores`` the n + k first items do. Scores are ranked by their rounded value, so items that
    are nearer than that to the last of them go along: of each weight the n + k largest items.
    """
    sizes = evidence.groupBy("basket").agg(F.count("*").alias("k"))
    places = n + (sizes.agg(F.max("k")).first()[0] or 0)
    last = weights.orderBy(F.desc("w"), F.desc("item")).limit(places).agg(F.min("w")).first()[0]
    if last is None:
        return evidence.select("basket", "item", F.lit(0.0).alias("score")).limit(0)
    same = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("item")))
    top = weights.where(F.col("w") >= last - 2e-9).withColumn("same", same).where(F.col("same") <= places).select("item", "w")
    few = top.limit(FEW + 1).count() <= FEW
    pairs = sizes.crossJoin(F.broadcast(top) if few else top)
    return without_evidence(pairs.select("basket", "item", (F.col("k") * F.col("w")).alias("score")), evidence)


def ranked(scores: DataFrame, n: int = -1, score: Column | None = None) -> DataFrame:
    """basket, item, score, rank from 1; n = -1 ranks all. Scores of zero or less are no recommendation."""
    value = F.round(F.col("score") if score is None else score, 9)
    place = F.row_number().over(Window.partitionBy("basket").orderBy(F.desc("_s"), F.desc("item")))
    rows = scores.withColumn("_s", value).where("_s > 0").withColumn("rank", place).drop("_s")
    return rows if n < 0 else rows.where(F.col("rank") <= n)


def recommend(evidence: DataFrame, edges: DataFrame | Graph, n: int = 10, stats: DataFrame | None = None) -> DataFrame:
    """The n best by edges, or by the paths of a graph; with ``stats`` of ``novel`` items only."""
    if isinstance(edges, Graph):
        return edges.best(evidence, n, stats is not None, rank=True).drop("sub")
    scores = without_evidence(additive_scores(evidence, edges), evidence)
    return ranked(scores if stats is None else novel(scores, evidence, stats), n)


def novel(scores: DataFrame, evidence: DataFrame, stats: DataFrame) -> DataFrame:
    """Only items less popular than the least popular of the evidence."""
    pops = stats.select("item", "pop")
    least = evidence.join(pops, "item").groupBy("basket").agg(F.min("pop").alias("least"))
    return scores.join(pops, "item").join(least, "basket").where("pop < least").drop("pop", "least")


def least_popular(items: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """basket, item: the n least popular of each basket."""
    place = F.row_number().over(Window.partitionBy("basket").orderBy("pop", "item"))
    return items.join(stats.select("item", "pop"), "item").withColumn("_p", place).where(F.col("_p") <= n).select("basket", "item")


def shuffled(items: DataFrame, n: int) -> DataFrame:
    """basket, item: n of each basket by a fixed arithmetic shuffle that any engine repeats."""
    key = (F.col("item") * 2654435761 + F.col("basket") * 40503) % 1000003
    place = F.row_number().over(Window.partitionBy("basket").orderBy(key, "item"))
    return items.withColumn("_p", place).where(F.col("_p") <= n).select("basket", "item")


def of_size(items: DataFrame, least: int) -> DataFrame:
    """Rows of baskets with ``least`` items or more."""
    return items.join(items.groupBy("basket").count().where(F.col("count") >= least), "basket", "left_semi")


def first_baskets(items: DataFrame, n: int) -> DataFrame:
    """The n first baskets by key; -1: all."""
    return items if n < 0 else items.join(items.select("basket").distinct().orderBy("basket").limit(n), "basket", "left_semi")
