"""Splits, folds and parameter grids."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.matrices import dimension
from .lineage import cut


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with idx, dense from 0 by a unique key."""
    return rows.join(dimension(rows, key), key)


def split_ratio(rows: DataFrame, key: str, test: float = 0.25) -> DataFrame:
    """idx and is_test: the last share of rows by key; the two sides never overlap."""
    all_ = numbered(rows, key)
    n = all_.agg(F.count("*").alias("n"))
    return all_.crossJoin(F.broadcast(n)).withColumn("is_test", F.col("idx") >= F.round((1 - test) * F.col("n"))).drop("n")


def folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """fold: the row's number modulo k. Fewer rows than k is an error."""
    out = numbered(rows, key)
    if out.limit(k).count() < k:
        raise ValueError(f"{k} folds need as many rows")
    return out.withColumn("fold", F.col("idx") % k)


def cross_validation(rows: DataFrame, key: str, k: int, judge: Callable[[DataFrame, DataFrame], float]) -> list[float]:
    """judge(train, test) for each fold, trained on the other folds."""
    placed = folds(rows, key, k).persist()
    out = [judge(placed.where(F.col("fold") != i).drop("fold", "idx"), placed.where(F.col("fold") == i).drop("fold", "idx")) for i in range(k)]
    placed.unpersist()
    return out


def grid(run: Callable[[dict], float], points: Iterable[dict], at_once: int = 1) -> list[tuple[dict, float]]:
    """run(point) for each point of a parameter grid, some Spark jobs at a time."""
    points = list(points)
    with ThreadPoolExecutor(at_once) as pool:
        return list(zip(points, pool.map(run, points), strict=True))


class Jobs:
    """A queue of jobs: ``add`` gives a ticket, ``get`` waits for its result, ``stop`` lets what is under way end."""

    def __init__(self, at_once: int = 1):
        self.pool, self.tickets = ThreadPoolExecutor(at_once), {}

    def add(self, run: Callable, *args, **options) -> str:
        ticket = uuid.uuid4().hex
        self.tickets[ticket] = self.pool.submit(run, *args, **options)
        return ticket

    def get(self, ticket: str):
        return self.tickets.pop(ticket).result()

    def stop(self) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)


def fitted(estimator, observations: DataFrame):
    """A worker that fits an estimator or pipeline (anything with ``fit``) on a table."""
    return estimator.fit(observations)


def train_then_evaluate(model, ui: DataFrame, judge: Callable):
    """judge(trained model): what a worker of the queue does for one model."""
    return judge(model.fit(ui))


def sweep(make: Callable[..., object], base: DataFrame, points: Iterable[dict], judge: Callable, at_once: int = 1) -> list[tuple[dict, object]]:
    """judge(make(**point).fit(base)) for each point; the base is written once and all points read it."""
    shared = cut(base)
    return grid(lambda point: train_then_evaluate(make(**point), shared, judge), points, at_once)


def best(results: DataFrame, by: str, *keys: str) -> DataFrame:
    """The row of the largest ``by`` for each key."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, "r.*")


def target(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Observations and target column."""
    if name not in rows.columns:
        raise ValueError(f"no column {name}")
    return rows.drop(name), rows.select(name)
