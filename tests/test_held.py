"""Walks and paths without edges against the steps over edges, on a graph of several components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.operators import held, kernels, statistics, walks
from trolley.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    cells = {(int(c), int(i) + 100 * (int(c) % 3)): float(w) for c, i, w in zip(rng.integers(0, 30, 150), rng.integers(0, 12, 150), rng.integers(1, 4, 150), strict=True)}
    cells |= {(90, 900): 2.0, (91, 901): 1.0, (91, 902): 1.0}  # an item alone, and two that only one customer connects
    ui = spark.createDataFrame([(c, i, w) for (c, i), w in cells.items()], "customer long, item long, w double").cache()
    items = spark.createDataFrame([(1, 1), (1, 2), (1, 101), (2, 203), (2, 4), (3, 105), (4, 900), (5, 901), (6, 1), (6, 77777), (7, 901), (7, 3), (7, 203)], "basket long, item long")
    return ui, items.join(ui.select("item").distinct(), "item", "left_semi").select("basket", "item").cache()


def stepped(name, ui, items, steps=4):
    stats = statistics.item_stats(ui)
    start = items.select(F.col("basket").alias("id"), "item", F.lit(1.0).alias("s"))
    t, p = kernels.transition(ui), kernels.to_probability(kernels.cooccurrence(ui))
    if name == "basket":
        return walks.basket_walk(start, t, 0.8, steps)
    if name == "pop":
        return walks.basket_walk(start, kernels.damped(t, stats, 500.0), 0.8, steps)
    if name == "restart":
        return walks.restart_walk(start, p, 0.5, steps)
    if name == "bn":
        return walks.restart_walk(start, kernels.to_probability(t), 0.5, steps)
    if name == "biased":
        return walks.restart_walk(start, kernels.biased(p, stats, 1.0, 3).localCheckpoint(), 0.5, steps)
    return walks.path_betweenness(start.select("id", "item"), kernels.damped(t, stats, 0.9, stats.agg(F.max("prior").alias("s"))).withColumn("w", 0.5 * F.col("w")), steps)


HOW = {
    "basket": (catalogue.transitions, held.walk(0.8, 4, back=True)), "pop": (catalogue.transitions_damped, held.walk(0.8, 4, back=True)), "restart": (catalogue.cooccurrence_probabilities, held.walk(0.5, 4)),
    "bn": (catalogue.transition_probabilities, held.walk(0.5, 4)), "biased": (lambda h: (h.probability(), h.biased(1.0, 3)), held.walk(0.5, 4)), "paths": (catalogue.path_weights, held.between(4)),
}


@pytest.mark.parametrize("name", list(HOW))
def test_scores(spark, tables, name):
    ui, items = tables
    got = {(r.basket, r.item): r.score for r in held.recommend(items, ui, *HOW[name], -1).collect() if r.score > 1e-12}
    own = {tuple(r) for r in items.collect()}
    want = {(r.id, r.item): r.s for r in stepped(name, ui, items).collect() if r.s is not None and r.s > 1e-12 and (r.id, r.item) not in own}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-9)
    assert len({b for b, _ in got}) >= 5


def test_what_does_not_fit_steps_over_edges(spark, tables, monkeypatch):
    monkeypatch.setattr(held, "HELD", 5)
    assert not held.fits(tables[0])


def test_no_baskets(spark, tables):
    ui, items = tables
    assert held.recommend(items.limit(0), ui, *HOW["basket"], 3).collect() == []
