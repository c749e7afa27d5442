"""The store of experiments: six tables, get-or-create by label, and the joined view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "models": "id bigint, label string",
    "parameters": "id bigint, label string",
    "performances": "id bigint, label string",
    "results": "id bigint, model_id bigint",
    "model_parameter": "model_id bigint, parameter_id bigint, value double",
    "result_performance": "result_id bigint, performance_id bigint, value double",
}


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def save_store(store: dict[str, DataFrame], path: str) -> None:
    """Write the six tables as a new version below ``path``; a reader opens the last one that is complete."""
    spark = store["models"].sparkSession
    at = max(_versions(spark, path), default=-1) + 1
    for name, table in store.items():
        table.write.parquet(f"{path}/{at}/{name}")
    spark.range(1).write.parquet(f"{path}/{at}/complete")


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return [int(x) for x in names if x.isdigit() and fs.exists(hadoop.Path(f"{path}/{x}/complete/_SUCCESS"))]


def open_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The last version of the store at ``path``; empty tables if there is none."""
    at = max(_versions(spark, path), default=None)
    return empty_store(spark) if at is None else {name: spark.read.schema(s).parquet(f"{path}/{at}/{name}") for name, s in SCHEMAS.items()}


def add_result(store: dict[str, DataFrame], model: str, parameters: dict[str, float], performances: dict[str, float]) -> dict[str, DataFrame]:
    """``store`` with one result: labels are found or created, ids go on from the largest."""
    spark, out = store["models"].sparkSession, dict(store)
    labels = lambda names: spark.createDataFrame([(n,) for n in names], "label string")
    for table, names in (("models", [model]), ("parameters", parameters), ("performances", performances)):
        out[table] = get_or_create(out[table], labels(names))
    ids = lambda table: {r.label: r.id for r in out[table].join(F.broadcast(labels({"models": [model], "parameters": parameters, "performances": performances}[table])), "label").collect()}
    owner, result = ids("models")[model], (out["results"].agg(F.max("id")).first()[0] or 0) + 1
    own = lambda table, rows: out[table].unionByName(spark.createDataFrame(rows, SCHEMAS[table]))
    p, q = ids("parameters"), ids("performances")
    out["results"] = own("results", [(result, owner)])
    out["model_parameter"] = own("model_parameter", [(owner, p[n], float(v)) for n, v in parameters.items()])
    out["result_performance"] = own("result_performance", [(result, q[n], float(v)) for n, v in performances.items()])
    return out


def by_parameters(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """alpha, theta and a column a metric, from rows (metric, alpha, theta, value) of a sweep's files."""
    return rows.groupBy("alpha", "theta").pivot("metric", metrics).agg(F.max("value"))


def bars(scores: DataFrame, n: int = 50) -> DataFrame:
    """What a bar chart of scores shows: place, item, score of the n best."""
    best = scores.orderBy(F.desc("score"), F.desc("item")).limit(n)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), F.desc("item"))).alias("place"), "item", "score")


def lines(rows: DataFrame, x: str, y: str, series: str) -> DataFrame:
    """What a line chart shows: series, x and the mean of y."""
    return rows.groupBy(F.col(series).alias("series"), F.col(x).alias("x")).agg(F.avg(y).alias("y"))


def get_or_create(table: DataFrame, labels: DataFrame) -> DataFrame:
    """``table`` (id, label) with a row for each label that it lacked."""
    new = labels.select("label").distinct().join(table, "label", "left_anti")
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    rank = F.row_number().over(Window.orderBy("label"))  # labels of one experiment: few
    return table.unionByName(new.crossJoin(last).select((F.col("last") + rank).cast("bigint").alias("id"), "label"))


def results_of(store: dict[str, DataFrame], label: str) -> DataFrame:
    """result_id, performance, value of all results of the model with ``label``."""
    models = store["models"].where(F.col("label") == label).select(F.col("id").alias("model_id"))
    results = store["results"].join(models, "model_id", "left_semi").select(F.col("id").alias("result_id"))
    names = store["performances"].select(F.col("id").alias("performance_id"), F.col("label").alias("performance"))
    return results.join(store["result_performance"], "result_id").join(names, "performance_id").select("result_id", "performance", "value")


def merge_last(*tables: DataFrame, keys: list[str]) -> DataFrame:
    """Union of tables in which a later one wins for equal keys."""
    rows = None
    for at, t in enumerate(tables):
        t = t.withColumn("_at", F.lit(at))
        rows = t if rows is None else rows.unionByName(t)
    rest = [c for c in rows.columns if c not in (*keys, "_at")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_r")).select(*keys, "_r.*")


def matching(spark: SparkSession, path: str, part: str) -> DataFrame:
    """All result files below ``path`` whose path holds ``part``, with their path."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path).withColumn("path", F.input_file_name())
    return rows.where(F.col("path").contains(part))


def write_recommendations(reco: DataFrame, customers: DataFrame, items: DataFrame, path: str) -> None:
    """Write (basket, item) as CSV of the original ids, by the dimensions (customer, idx) and (item, idx)."""
    who = customers.select(F.col("idx").alias("basket"), "customer")
    what = items.select(F.col("idx").alias("_i"), F.col("item").alias("_item"))
    reco.join(who, "basket").join(what, reco["item"] == what["_i"]).select("customer", F.col("_item").alias("item")).write.option("header", True).csv(path)


def write_means(means: DataFrame, path: str) -> None:
    """Write (model, parameters.., metric, value) rows as JSON lines."""
    means.write.json(path)
