"""Matrices as tables (row, col, value), read and written as MatrixMarket text or parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """row, col (from 0) and value of a sparse coordinate file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("begins"), F.monotonically_increasing_id().alias("at"))
    heads = lines.where(F.col("value").startswith("%%")).select("file").distinct()
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    shape = body.where("begins").join(F.broadcast(heads), "file").groupBy("file").agg(F.min("at").alias("at"))  # the first line below a head has the shape
    parts = F.split(F.trim("value"), r"\s+")
    cells = body.join(F.broadcast(shape), ["file", "at"], "left_anti")  # a row a file with a head
    return cells.select((parts[0].cast("bigint") - 1).alias("row"), (parts[1].cast("bigint") - 1).alias("col"), F.get(parts, F.lit(2)).cast("double").alias("value"))


def read_dense_matrix_market(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A column-major array file as rows (row, *names)."""
    lines = spark.read.option("wholetext", True).text(path).select(F.explode(F.split("value", "\n")).alias("v"))
    body = lines.where(~F.col("v").startswith("%") & (F.trim("v") != ""))
    each = body.agg(F.collect_list("v").alias("v")).select(F.split(F.col("v")[0], " ")[0].cast("int").alias("n"), F.slice("v", 2, F.size("v")).alias("v"))
    columns = [F.transform(F.slice("v", F.col("n") * k + 1, F.col("n")), lambda x: x.cast("double")).alias(name) for k, name in enumerate(names)]
    return each.select(F.posexplode(F.arrays_zip(*columns)).alias("row", "z")).select("row", *(F.col("z")[name].alias(name) for name in names))


def write_matrix_market(cells: DataFrame, path: str) -> None:
    """Write (row, col, value), from 0, as coordinate text: a folder whose parts follow one another."""
    size = cells.agg(F.max("row") + 1, F.max("col") + 1, F.count("*")).first()
    head = cells.sparkSession.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{size[0]} {size[1]} {size[2]}")], "at int, line string")
    body = cells.select(F.lit(2).alias("at"), F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("value")).alias("line"))
    head.unionByName(body).repartitionByRange("at", "line").sortWithinPartitions("at", "line").select("line").write.text(path)


def write_dense_matrix_market(rows: DataFrame, path: str, *names: str, order: str) -> None:
    """Write columns of doubles, rows in the order of a column, as a column-major array file: a folder whose parts follow one another."""
    cells = rows.select(order, F.posexplode(F.array(*(F.col(n).cast("double") for n in names))).alias("c", "v"))
    body = cells.select(F.lit(2).alias("at"), F.col("c").cast("long").alias("c"), F.col(order).alias("r"), F.col("v").cast("string").alias("line"))
    n = rows.count()
    head = rows.sparkSession.createDataFrame([(0, "%%MatrixMarket matrix array real general"), (1, f"{n} {len(names)}")], "at int, line string")
    head = head.select("at", F.lit(0).cast("long").alias("c"), F.lit(None).cast(body.schema["r"].dataType).alias("r"), "line")
    head.unionByName(body).repartitionByRange("at", "c", "r").sortWithinPartitions("at", "c", "r").select("line").write.text(path)


def write_baskets(baskets: DataFrame, customers: DataFrame, items: DataFrame, path: str) -> None:
    """Write baskets and the two dictionaries (customer, idx) and (item, idx) as tables below ``path``."""
    for name, table in (("baskets", baskets), ("customers", customers), ("items", items)):
        table.write.parquet(f"{path}/{name}")


def dimension(rows: DataFrame, key: str) -> DataFrame:
    """key and idx, dense from 0 in the order of the key.

    Numbers come from counts of ordered partitions, so no task sorts everything.
    """
    ranged = rows.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key)
    placed = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    counts = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    if not before:
        return placed.select(key, F.col("_i").alias("idx"))
    offsets = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    return placed.select(key, (F.element_at(offsets, F.col("_p")) + F.col("_i")).cast("bigint").alias("idx"))


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``path`` if it is a finished table, else build and write it first."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
