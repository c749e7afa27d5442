"""The small fixture worked out by hand, and invariants."""

import pytest
from pyspark.sql import functions as F

from trolley.functions.models import Marginal, Paths
from trolley.operators import evaluation, interactions, kernels, ranking, splits, statistics, walks
from trolley.sources.transactions import read_purchases, toy


@pytest.fixture(scope="module")
def data(spark):
    train, test = toy(spark)
    ui = interactions.interactions(train)
    return train, test, ui, statistics.item_stats(ui)


def cells(df, *keys, value="w"):
    return {tuple(r[k] for k in keys): pytest.approx(r[value], abs=1e-5) for r in df.collect()}


def test_statistics(data):
    _, _, ui, stats = data
    assert {(r.item, r.pop, r.users) for r in stats.collect()} == {(10, 4, 3), (20, 3, 3), (30, 2, 2), (40, 1, 1)}
    assert cells(statistics.idf(ui), "item", value="idf") == {(10,): 0.287682, (20,): 0.287682, (30,): 0.693147, (40,): 1.386294}
    assert statistics.mean_of_top_priors(stats).first().m == pytest.approx(0.25)
    assert cells(kernels.marginal(ui), "item") == {(10,): 0.208333, (20,): 0.224525, (30,): 0.294628, (40,): 0.333333}


def test_kernels(data):
    _, _, ui, stats = data
    assert cells(kernels.transition(ui), "src", "dst")[10, 20] == 7 / 18
    assert cells(kernels.transition(ui, True).groupBy("dst").agg(F.sum("w").alias("w")), "dst") == {(k,): 1.0 for k in (10, 20, 30, 40)}
    assert cells(kernels.cosine(ui), "src", "dst")[10, 30] == 0.288675
    assert cells(kernels.conditional(ui), "src", "dst")[10, 20] == 0.384900
    b = cells(kernels.biased(kernels.to_probability(kernels.cooccurrence(ui)), stats, 1.0, 12), "src", "dst")
    assert b[10, 20] == pytest.approx(0.641118, abs=1e-3) and b[40, 30] == pytest.approx(0.626772, abs=1e-3)


def test_walks(spark, data):
    _, _, ui, _ = data
    start = spark.createDataFrame([(1, 10, 1.0), (1, 20, 1.0)], "id bigint, item bigint, s double")
    p = kernels.to_probability(kernels.cooccurrence(ui))
    assert cells(walks.restart_walk(start, p, 0.5, 10), "item", value="s") == {(10,): 0.795081, (20,): 0.864426, (30,): 0.216203, (40,): 0.122336}
    s, _ = walks.converged(start, p, 0.5, 1e-9)
    assert cells(s, "item", value="s")[10,] == 0.795640


def test_paths(spark, data):
    evidence = spark.createDataFrame([(1, 10), (1, 20)], "basket bigint, item bigint")
    got = cells(Paths(0.5, 1.0, 10).fit(data[2]).scores(evidence), "item", value="score")
    assert got == {(30,): 0.045463, (40,): 0.027293}


def test_baskets_and_ties(spark, data):
    _, test, ui, _ = data
    assert {r.basket: r["items"] for r in interactions.baskets(test, ui, "basket").collect()} == {1: [10, 20, 30], 2: [20, 40], 3: [10], 4: []}
    one = spark.createDataFrame([(1, 20)], "basket bigint, item bigint")
    assert [r.item for r in ranking.recommend(one, kernels.cooccurrence(ui), -1).orderBy("rank").collect()] == [10, 40, 30]


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_short_ways_score_alike(data, monkeypatch, few):
    _, test, ui, stats = data
    monkeypatch.setattr(ranking, "FEW", few)
    items = interactions.basket_items(test, ui)
    rows = lambda df: cells(df, "basket", "item", value="score")
    long = ranking.without_evidence(ranking.additive_scores(items, kernels.cooccurrence(ui)), items)
    assert rows(ranking.without_evidence(ranking.cooccurrence_scores(items, ui), items)) == rows(long)
    assert rows(ranking.cooccurrence_scores(items, ui, stats)) == rows(ranking.novel(long, items, stats))
    model = Marginal().fit(ui)
    for n in (1, 2, 10):
        assert rows(model.recommend(items, n)) == rows(ranking.ranked(ranking.without_evidence(model.scores(items), items), n))
    assert model.recommend(items.limit(0), 2).count() == 0


def test_metrics(data):
    _, test, ui, stats = data
    items = interactions.basket_items(test, ui).where("basket = 1")
    edges = kernels.cooccurrence(ui)
    value = lambda df: df.first().value
    assert value(evaluation.rare_item_hit(items, edges, stats, 1)) == 1
    assert value(evaluation.weighted_leave_one_out(items, edges, stats, 1)) == 1
    assert value(evaluation.novelty(items, edges, stats, 1, statistics.mean_of_top_priors(stats))) == pytest.approx(0.2)


def test_folds_and_reader(spark, tmp_path):
    rows = spark.range(12).select(F.col("id").alias("k"))
    assert {r.fold: r["count"] for r in splits.folds(rows, "k", 3).groupBy("fold").count().collect()} == {0: 4, 1: 4, 2: 4}
    (tmp_path / "a.csv").write_text("c,i\n1,2\n3,4\n")
    assert [tuple(r) for r in read_purchases(spark, str(tmp_path / "a.csv")).collect()] == [(1, 2), (3, 4)]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
