"""Item statistics and cell statistics of the user-item table; absent cells are zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total(ui: DataFrame) -> DataFrame:
    return ui.agg(F.sum("w").alias("total"))


def item_stats(ui: DataFrame) -> DataFrame:
    """item, pop, prior, users."""
    per = ui.groupBy("item").agg(F.sum("w").alias("pop"), F.count("*").alias("users"))
    return per.crossJoin(F.broadcast(total(ui))).select("item", "pop", (F.col("pop") / F.col("total")).alias("prior"), "users")  # one row


def cardinalities(ui: DataFrame) -> DataFrame:
    return ui.agg(F.count_distinct("customer").alias("n_users"), F.count_distinct("item").alias("n_items"))


def cell_stats(ui: DataFrame) -> DataFrame:
    """mean, std (population) and max over all cells, zeros among them."""
    sums = ui.agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"), F.max("w").alias("max"), F.count_distinct("customer").alias("u"), F.count_distinct("item").alias("i"))
    n = F.col("u") * F.col("i")
    return sums.select((F.col("s") / n).alias("mean"), F.sqrt(F.col("q") / n - F.pow(F.col("s") / n, F.lit(2))).alias("std"), "max")


def mean_of_top_priors(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("prior"), F.desc("item")).limit(k).agg(F.avg("prior").alias("m"))


def row_normalised(ui: DataFrame) -> DataFrame:
    """w over the customer's sum."""
    sums = ui.groupBy("customer").agg(F.sum("w").alias("r"))
    return ui.join(sums, "customer").select("customer", "item", (F.col("w") / F.col("r")).alias("w"))


def tf(ui: DataFrame) -> DataFrame:
    """w over the customer's number of different items."""
    n = ui.groupBy("customer").agg(F.count("*").alias("n"))
    return ui.join(n, "customer").select("customer", "item", (F.col("w") / F.col("n")).alias("tf"))


def idf(ui: DataFrame, whole: bool = False) -> DataFrame:
    """ln(users / users of the item); ``whole`` floors the quotient first."""
    n = ui.agg(F.count_distinct("customer").alias("n"))
    q = F.col("n") / F.col("df")
    return ui.groupBy("item").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("item", F.log(F.floor(q) if whole else q).alias("idf"))


def nnz(ui: DataFrame, by: str) -> DataFrame:
    return ui.groupBy(by).agg(F.count_if(F.col("w") != 0).alias("nnz"))


def normalised_by_mean(ui: DataFrame) -> DataFrame:
    """w over the mean of all cells."""
    return ui.crossJoin(F.broadcast(cell_stats(ui).select("mean"))).select("customer", "item", (F.col("w") / F.col("mean")).alias("w"))


def standardised(ui: DataFrame) -> DataFrame:
    """customer, item, z of the present cells; mean and deviation of an item's column count its zeros."""
    users = ui.agg(F.count_distinct("customer").alias("u"))
    per = ui.groupBy("item").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).crossJoin(F.broadcast(users))
    per = per.select("item", (F.col("s") / F.col("u")).alias("m"), F.sqrt(F.col("q") / F.col("u") - F.pow(F.col("s") / F.col("u"), F.lit(2))).alias("d"))
    return ui.join(per, "item").select("customer", "item", F.try_divide(F.col("w") - F.col("m"), "d").alias("z"))
