"""Sums over paths in blocks against the edges they stand for."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trolley.operators import blocks, evaluation, kernels, ranking, statistics
from trolley.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def ui(spark):
    rng = np.random.default_rng(5)
    cells = {(int(c), int(i) * 7): float(w) for c, i, w in zip(rng.integers(0, 40, 400), rng.integers(0, 30, 400) ** 2, rng.integers(1, 4, 400), strict=True)}
    return spark.createDataFrame([(c, i, w) for (c, i), w in cells.items()], "customer long, item long, w double").cache()


def rows(df, *names):
    return {tuple(r[:-1]): r[-1] for r in df.select(*names).collect()}


def same(a, b):
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-12)


@pytest.mark.parametrize("limits", [{}, {"HOPS": 7, "PATHS": 5, "CELLS": 3}, {"DENSE": 0, "PATHS": 900}])
@pytest.mark.parametrize("name", ["cooccurrence", "cosine", "conditional", "transition", "probability"])
def test_edges(spark, ui, monkeypatch, name, limits):
    for k, v in limits.items():
        monkeypatch.setattr(blocks, k, v)
    want = {"cooccurrence": kernels.cooccurrence, "cosine": kernels.cosine, "conditional": kernels.conditional, "transition": kernels.transition, "probability": lambda x: kernels.to_probability(kernels.cooccurrence(x))}[name](ui)
    same(rows(getattr(kernels, f"{name}_paths")(ui).edges(name in ("cosine", "conditional")), "src", "dst", "w"), rows(want, "src", "dst", "w"))


def test_biased(spark, ui, monkeypatch):
    stats = statistics.item_stats(ui)
    alone = ui.unionByName(spark.createDataFrame([(99, 5000, 2.0), (98, 5001, 1.0), (98, 5002, 1.0)], ui.schema))
    for table in (ui, alone):
        stats = statistics.item_stats(table)
        want = kernels.biased(kernels.to_probability(kernels.cooccurrence(table)).localCheckpoint(), stats, 1.0, 3)
        same(rows(kernels.biased_paths(table, stats, 1.0, 3).edges(), "src", "dst", "w"), rows(want, "src", "dst", "w"))
    monkeypatch.setattr(kernels, "ITEMS", 3)
    assert kernels.biased_paths(ui, stats, 1.0, 3) is None


@pytest.mark.parametrize("n", [3, -1])
def test_recommendations(spark, ui, n):
    stats = statistics.item_stats(ui)
    items = ui.where("customer % 3 = 0").select((F.col("customer") * 100 - 500).alias("basket"), "item").unionByName(spark.createDataFrame([(1, 5), (2, 5)], "basket long, item long"))  # 5 is unknown
    names = "basket", "item", "rank", "score"
    same(rows(ranking.recommend(items, kernels.cooccurrence_paths(ui), n), *names), rows(ranking.recommend(items, kernels.cooccurrence(ui), n), *names))
    same(rows(ranking.recommend(items, kernels.conditional_sums(ui), n), *names), rows(ranking.recommend(items, kernels.conditional(ui), n), *names))
    same(rows(ranking.recommend(items, kernels.cooccurrence_paths(ui, stats), n, stats), *names), rows(ranking.recommend(items, kernels.cooccurrence(ui), n, stats), *names))


@pytest.mark.parametrize("metric", list(evaluation.METRICS))
def test_metrics(spark, ui, metric):
    stats = statistics.item_stats(ui)
    items = ui.where("customer % 3 = 0 and item % 2 = 0").select(F.col("customer").alias("basket"), "item")
    values = [rows(evaluation.evaluate(items, g, stats, 2, [metric]), "basket", "value") for g in (kernels.cooccurrence_paths(ui, stats), kernels.cooccurrence(ui))]
    same(*values)
    assert values[0]


def test_no_rows(spark, ui):
    none = ui.limit(0)
    assert kernels.cooccurrence_paths(none).edges().collect() == []
    assert ranking.recommend(none.select(F.col("customer").alias("basket"), "item"), kernels.cooccurrence_paths(ui), 3).collect() == []


def test_rounding(spark):
    x = [0.0078125, 0.5, 1.0000005, 2.5e-7, 1 / 3, 12345.6789015, 5e-7, 0.0009765625, 1.4999995]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert blocks.rounded(np.array(x), 6).tolist() == want


@pytest.mark.parametrize("name", ["transition_parts", "reco_full_ranking_parts"])
def test_rows_equal_the_sql(spark, sql, tmp_path, name):
    catalogue.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/got")
    sql.sql(f"CREATE OR REPLACE TABLE want AS {catalogue.ORACLES[name]}")
    columns = [c[0] for c in sql.sql("DESCRIBE want").fetchall()]
    got = f"SELECT {', '.join(columns)} FROM '{tmp_path}/got/*.parquet'"
    assert sql.sql(f"({got} EXCEPT ALL SELECT * FROM want) UNION ALL (SELECT * FROM want EXCEPT ALL {got})").fetchall() == []


@pytest.mark.parametrize("limits", [{"ENTRIES": 0}, {"ITEMS": 3}, {"PACK": 1, "BLOCKS": 3}, {"PACK": 7, "PATHS": 5}])
@pytest.mark.parametrize("name", ["cooccurrence", "cosine", "conditional", "transition", "probability"])
def test_packed_or_not(spark, ui, monkeypatch, name, limits):
    """Counts that tasks may hold packed give the edges of those that they may not."""
    want = rows(getattr(kernels, f"{name}_paths")(ui).edges(), "src", "dst", "w")
    for k, v in limits.items():
        monkeypatch.setattr(blocks, k, v)
    same(rows(getattr(kernels, f"{name}_paths")(ui).edges(), "src", "dst", "w"), want)


def test_lists_of_many_blocks_are_small(spark):
    """Where the items of a customer are of all blocks, four bytes a row and block are sent, and no more blocks than a few."""
    rng = np.random.default_rng(3)
    masks = (np.uint64(1) << rng.integers(0, 12, 5000).astype(np.uint64)).astype(np.uint64)
    customer, item = np.repeat(np.arange(500), 40), np.concatenate([np.sort(rng.choice(5000, 40, replace=False)) for _ in range(500)])
    batches = [pa.record_batch({"customer": customer[k : k + 777], "item": item[k : k + 777] * 3, "x": np.ones(len(item[k : k + 777]))}) for k in range(0, len(item), 777)]
    got, sent = {}, 0
    for batch in blocks.packed(batches, np.arange(5000) * 3, masks):
        sent += batch.nbytes
        for b in range(12):
            part = batch.filter(pa.array(batch.column("block").to_numpy() == b))
            if len(part):
                got.setdefault(b, blocks.Lists(len(item))).add(*(part.column(c) for c in ("n", "low", "high", "x")))
    of = masks[item].reshape(500, 40)
    for b in range(12):
        whole = np.flatnonzero((of >> np.uint64(b) & np.uint64(1)).any(1))
        n, items, x = got[b].arrays()
        assert (n == 40).all() and (items.reshape(-1, 40) == item.reshape(500, 40)[whole]).all() and (x == 1).all()
    assert sent < 12 * len(item) * 4.5


def test_ranks_without_a_shuffle(spark, ui):
    """Ranks are given where a basket is scored, and are those of a window over all scores."""
    evidence = spark.createDataFrame([(b, 7 * i * i) for b in range(12) for i in {b, b % 5, 3}], "basket long, item long")
    for n in (2, 1000, -1):
        best = ranking.recommend(evidence, kernels.cooccurrence_paths(ui), n)
        assert "Window" not in best._jdf.queryExecution().executedPlan().toString()
        want = ranking.recommend(evidence, kernels.cooccurrence(ui), n)
        names = ("basket", "item", "score", "rank")
        assert rows(best, *names) == rows(want, *names)
