"""Transaction sources. Every reader takes an explicit schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, paths: str | list[str], columns: dict[int, tuple[str, str]], sep: str = ";", header: bool = True) -> DataFrame:
    """Columns of delimited files by ordinal, as {ordinal: (name, type)}; several paths are one union.

    A row with fewer columns than the last ordinal raises, as a wrong separator would else pass.
    """
    width = max(columns) + 1
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
    reader = spark.read.schema(schema.add("_line", T.StringType())).option("columnNameOfCorruptRecord", "_line")
    rows = reader.option("sep", sep).option("header", header).option("enforceSchema", True).csv(paths)
    short = F.col(f"_{width - 1}").isNull() & (F.size(F.split("_line", f"\\Q{sep}\\E")) < width)  # an empty last field is a field
    checked = F.when(short, F.raise_error(F.concat(F.lit(f"a row has fewer than {width} columns: "), F.to_json(F.struct(*rows.columns))))).otherwise(F.col(f"_{width - 1}"))
    rows = rows.withColumn(f"_{width - 1}", checked.cast("string"))
    return rows.select(*(F.col(f"_{i}").cast(kind).alias(name) for i, (name, kind) in columns.items()))


def read_grocery(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ts, customer, item of semicolon files with a header: ordinals 0, 1 and 4."""
    return read_delimited(spark, paths, {0: ("ts", "timestamp"), 1: ("customer", "bigint"), 4: ("item", "bigint")})


def read_purchases(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """customer, item of comma files with a header."""
    return read_delimited(spark, paths, {0: ("customer", "bigint"), 1: ("item", "bigint")}, sep=",")


def read_ratings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """customer, item, rating, ts of tab-separated ratings without a header."""
    return read_delimited(spark, paths, {0: ("customer", "bigint"), 1: ("item", "bigint"), 2: ("rating", "int"), 3: ("ts", "bigint")}, sep="\t", header=False)


def read_numbers(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """A table of doubles without a header."""
    return read_delimited(spark, path, {i: (n, "double") for i, n in enumerate(names)}, sep=sep, header=False)


def load(spark: SparkSession, train: list[str], test: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The default data: user-item counts (customer, item, w) of some files, baskets (customer, item) of known items of another."""
    from ..operators.interactions import in_vocabulary, interactions

    ui = interactions(read_grocery(spark, train))
    return ui, in_vocabulary(read_grocery(spark, test).select("customer", "item").distinct(), ui)


def star_transactions(spark: SparkSession, sf_dir: str, universe: str = "part") -> DataFrame:
    """customer, item, basket, day of the star schema; items are parts, or brands by number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    item = F.col("l_partkey")
    if universe == "brand":
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
        rows, item = rows.join(parts, F.col("l_partkey") == F.col("p_partkey")), F.substring("p_brand", 7, 10).cast("bigint")
    return rows.select(F.col("o_custkey").alias("customer"), item.alias("item"), F.col("o_orderkey").alias("basket"), F.to_date("o_orderdate").alias("day"))


def toy(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small network: purchases (customer, item) and test baskets (basket, item)."""
    bought = {1: [10, 10, 20], 2: [10, 30], 3: [20, 30, 40], 4: [10, 20]}
    asked = {1: [10, 20, 30], 2: [20, 40], 3: [10, 99], 4: [99]}
    pairs = lambda d: [(k, i) for k, items in d.items() for i in items]
    return spark.createDataFrame(pairs(bought), "customer bigint, item bigint"), spark.createDataFrame(pairs(asked), "basket bigint, item bigint")
