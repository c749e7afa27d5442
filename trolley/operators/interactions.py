"""From transactions to the user-item table and test baskets."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFF = datetime.date(2001, 2, 1)


def split_by_date(rows: DataFrame, day: str = "day", cutoff: datetime.date = CUTOFF) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and the rest; the time of day is ignored."""
    before = F.to_date(day) < F.lit(cutoff)
    return rows.where(before), rows.where(~before)


def interactions(rows: DataFrame, weight: str = "count") -> DataFrame:
    """customer, item, w: purchases counted, as ln(1 + count), or as 1."""
    value: dict[str, Column] = {"count": F.count("*").cast("double"), "log": F.log1p(F.count("*").cast("double")), "binary": F.lit(1.0)}
    return rows.groupBy("customer", "item").agg(value[weight].alias("w")) if weight != "binary" else rows.select("customer", "item").distinct().withColumn("w", value[weight])


def vocabulary(ui: DataFrame) -> DataFrame:
    return ui.select("item").distinct()


def in_vocabulary(rows: DataFrame, ui: DataFrame) -> DataFrame:
    return rows.join(vocabulary(ui), "item", "left_semi")


def baskets(rows: DataFrame, ui: DataFrame, *key: str) -> DataFrame:
    """key and items: the distinct known items in order; a basket of unknown items stays, empty."""
    known = vocabulary(ui).select("item", F.col("item").alias("known"))
    return rows.select(*key, "item").distinct().join(known, "item", "left").groupBy(*key).agg(F.sort_array(F.collect_list("known")).alias("items"))


def basket_lists(rows: DataFrame, order: str, *key: str) -> DataFrame:
    """key and items with repetitions, in the order of a column: the rating loader's baskets."""
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "item"))), lambda x: x["item"]).alias("items"))


def basket_items(rows: DataFrame, ui: DataFrame, key: str = "basket") -> DataFrame:
    """basket, item: the distinct known items of test rows."""
    return in_vocabulary(rows.select(F.col(key).alias("basket"), "item").distinct(), ui)
