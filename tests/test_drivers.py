"""Drivers, stores, sinks and readers."""

import pytest
from pyspark.sql import functions as F

from trolley.functions.models import MODELS, Additive, Popularity, Topics
from trolley.operators import evaluation, kernels, splits, statistics, topics
from trolley.sources import matrices, results, transactions


@pytest.fixture(scope="module")
def toy(spark):
    bought, asked = transactions.toy(spark)
    ui = bought.groupBy("customer", "item").agg(F.count("*").cast("double").alias("w"))
    return ui, asked


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("c,i\n1,2\n3,\n")
    assert [tuple(r) for r in transactions.read_purchases(spark, str(tmp_path / "a.csv")).collect()] == [(1, 2), (3, None)]
    (tmp_path / "b.csv").write_text("c,i\n1,2\n3\n")
    with pytest.raises(Exception, match="fewer than 2 columns"):
        transactions.read_purchases(spark, str(tmp_path / "b.csv")).collect()
    line = "2001-01-0{};{};x;y;{};z\n"
    (tmp_path / "t.csv").write_text("h;c;a;b;i;z\n" + line.format(1, 1, 10) + line.format(2, 1, 10) + line.format(3, 2, 20))
    (tmp_path / "u.csv").write_text("h;c;a;b;i;z\n" + line.format(4, 1, 20) + line.format(5, 1, 99))
    ui, test = transactions.load(spark, [str(tmp_path / "t.csv")], str(tmp_path / "u.csv"))
    assert sorted(map(tuple, ui.collect())) == [(1, 10, 2.0), (2, 20, 1.0)] and [(r.customer, r.item) for r in test.collect()] == [(1, 20)]


def test_matrices(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part-0").write_text("%%MatrixMarket matrix coordinate real general\n3 3 6\n1 1 1.5\n")
    (tmp_path / "m" / "part-1").write_text("1 2 2.0\n1 3 3.0\n2 1 4.0\n2 2 5.0\n3 3 6.0\n")
    got = sorted(tuple(r) for r in matrices.read_matrix_market(spark, str(tmp_path / "m")).collect())
    assert got == [(0, 0, 1.5), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0), (2, 2, 6.0)]
    cells = spark.createDataFrame(got, "row long, col long, value double")
    matrices.write_matrix_market(cells, str(tmp_path / "w"))
    assert sorted(tuple(r) for r in matrices.read_matrix_market(spark, str(tmp_path / "w")).collect()) == got
    dense = spark.createDataFrame([(k, k / 2, -1.0) for k in range(5)], "basket long, a double, b double")
    matrices.write_dense_matrix_market(dense, str(tmp_path / "d"), "a", "b", order="basket")
    text = [r.value for f in sorted((tmp_path / "d").glob("part-*")) for r in spark.read.text(str(f)).collect()]
    assert text == ["%%MatrixMarket matrix array real general", "5 2", "0.0", "0.5", "1.0", "1.5", "2.0", *["-1.0"] * 5]
    matrices.write_baskets(dense, dense, dense, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "items")).count() == 5


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store = results.open_store(spark, path)
    for k in range(2):
        store = results.add_result(store, "walk", {"alpha": 0.5 + k}, {"hit": 0.25 * k, "novelty": 1.0})
        results.save_store(store, path)
        store = results.open_store(spark, path)
    assert store["models"].count() == 1 and store["results"].count() == 2
    assert sorted((r.performance, r.value) for r in results.results_of(store, "walk").collect()) == [("hit", 0.0), ("hit", 0.25), ("novelty", 1.0), ("novelty", 1.0)]
    rows = spark.createDataFrame([("hit", 0.1, 1.0, 0.5), ("novelty", 0.1, 1.0, 0.7)], "metric string, alpha double, theta double, value double")
    assert [tuple(r) for r in results.by_parameters(rows, ["hit", "novelty"]).collect()] == [(0.1, 1.0, 0.5, 0.7)]
    assert [tuple(r) for r in results.lines(rows, "alpha", "value", "metric").orderBy("series").collect()] == [("hit", 0.1, 0.5), ("novelty", 0.1, 0.7)]
    scores = spark.createDataFrame([(1, 0.5), (2, 0.9)], "item long, score double")
    assert [tuple(r) for r in results.bars(scores, 1).collect()] == [(1, 2, 0.9)]


def test_evaluation_in_one_call(spark, toy):
    ui, items = toy
    edges, stats = kernels.cooccurrence(ui), statistics.item_stats(ui)
    known = items.join(stats.select("item"), "item", "left_semi").select("basket", "item")
    values = evaluation.evaluate(known, edges, stats, 1)
    for name in evaluation.METRICS:
        one = evaluation.METRICS[name](known, edges, stats, 1, statistics.mean_of_top_priors(stats))
        assert sorted(map(tuple, one.collect())) == sorted((r.basket, r.value) for r in values.where(F.col("metric") == name).collect())
    matrix = evaluation.performance_matrix(values, known)
    assert matrix.columns == ["basket", *evaluation.METRICS] and matrix.count() == known.select("basket").distinct().count()


def test_lists_with_the_guard(toy):
    ui, items = toy
    got = {r.basket: r["items"] for r in Additive().fit(ui).recommend_all(items, 2).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == [] and all(len(x) <= 2 for x in got.values()) and got[2]
    assert MODELS["paths_alias"] is MODELS["paths"]


def test_topics(spark, toy, tmp_path):
    rows = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 5.0), (2, 1.0), (2, 3.0)], "z int, p double")
    assert sorted(r.p for r in topics.normalised(rows, "p", "z").collect()) == [0.0, 0.0, 0.25, 0.75, 5.0]
    model = topics.train(toy[0], 2, 30, tolerance=1e-2)
    topics.save(model, str(tmp_path / "m"))
    again = topics.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.p_w.select("item", "z", "p").collect())) == sorted(map(tuple, model.p_w.select("item", "z", "p").collect()))
    assert Topics(2, 2).fit(toy[0]).recommend(toy[1], 2).count() > 0


def test_jobs_and_sweeps(toy):
    ui, items = toy
    jobs = splits.Jobs(2)
    tickets = [jobs.add(splits.train_then_evaluate, Popularity(), ui, lambda m, n=n: m.recommend(items, n).count()) for n in (1, 2)]
    one, two = map(jobs.get, tickets)
    jobs.stop()
    assert 0 < one <= two
    found = splits.sweep(Additive, ui, [{"kernel": k} for k in ("cooccurrence", "cosine")], lambda m: m.recommend(items, 1).count())
    assert [p["kernel"] for p, _ in found] == ["cooccurrence", "cosine"] and all(n > 0 for _, n in found)


def test_command_line(spark, tmp_path):
    from trolley.__main__ import main

    out = main(["additive", "--data", "/root/testdata/sf0.001", "--universe", "brand", "--kernel", "cosine", "--n", "3", "--out", str(tmp_path / "r")], spark)
    assert out["recommendations"] == spark.read.parquet(str(tmp_path / "r")).count() > 0
