"""Queries on parts: with their SQL in DuckDB, and walks, paths and topics with dense arrays."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def dense(sql):
    """Users x parts, and the known parts of each test basket."""
    ui = sql.sql(catalogue.o.q(catalogue.o.base("part"), "SELECT customer, item, w FROM ui")).fetchall()
    users, items = sorted({r[0] for r in ui}), sorted({r[1] for r in ui})
    w = np.zeros((len(users), len(items)))
    for c, i, n in ui:
        w[users.index(c), items.index(i)] = n
    baskets = {}
    for b, i in sql.sql(catalogue.o.q(catalogue.o.base("part"), "SELECT basket, item FROM bi")).fetchall():
        baskets.setdefault(b, []).append(items.index(i))
    return users, items, w, baskets


def test_what_stays_on_brands():
    on_parts = {k for k, text in catalogue.ORACLES.items() if catalogue.o.base("part") in text} | {k for k in catalogue.QUERIES if k.endswith("_parts")}
    only = {k for k in catalogue.QUERIES if k not in on_parts and f"{k}_parts" not in on_parts and (k not in catalogue.ORACLES or catalogue.o.base() in catalogue.ORACLES[k])}
    assert only == {"root_distance", "lsa_smoothed"} and "cooccurrence_edges_parts" in on_parts


@pytest.mark.parametrize("name", ["cooccurrence_edges", "cosine", "conditional", "marginal", "transition", "to_probability", "standardised", "reco_full_ranking", "reco_conditional", "reco_marginal", "metric_rare_item_hit", "metric_shuffled_hit", "metric_leave_one_out", "metric_novelty", "metric_mean_prior", "mean_performance"])
def test_sql(spark, sql, name):
    by = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    got = sorted((tuple(r) for r in catalogue.QUERIES[f"{name}_parts"](spark, SF).collect()), key=by)
    want = sorted(sql.sql(catalogue.ORACLES[f"{name}_parts"]).fetchall(), key=by)
    assert [by(r) for r in got] == [by(r) for r in want]
    assert np.allclose([x for r in got for x in r if isinstance(x, float)], [x for r in want for x in r if isinstance(x, float)], rtol=0, atol=2e-6)


def off_diagonal(x):
    return x - np.diag(np.diag(x))


def rows_to_one(x):
    return x / x.sum(1, keepdims=True)


def biased(p, prior):
    w, v = p * np.exp(-prior / prior.mean()), np.ones(len(p))
    for _ in range(30):
        v = w @ v
        v = v / v.max()
    return rows_to_one(w * v)


def walk(start, edges, alpha):
    s = (1 - alpha) * start
    for _ in range(9):
        s = alpha * s @ edges + (1 - alpha) * start
    return s


def between(known, w):
    free = np.ones(len(w))
    free[known] = 0
    start = 1 - free
    term = first = forward = start @ w
    back = reach = start
    for _ in range(9):
        term = (term * free) @ w
        forward = forward + term
        back = (w @ back) * free
        reach = reach + back
    return forward * reach / (first @ reach)


@pytest.mark.parametrize("name", ["reco_basket_walk", "reco_basket_walk_pop", "reco_restart_walk", "reco_restart_walk_bn", "reco_biased_walk", "reco_paths"])
def test_walks(spark, dense, name):
    _, items, w, baskets = dense
    prior = w.sum(0) / w.sum()
    t, p = off_diagonal(rows_to_one(w).T @ (w / w.sum(0))), rows_to_one(off_diagonal(w.T @ w))
    edges, alpha = {
        "reco_basket_walk": (t.T, 0.8), "reco_basket_walk_pop": ((t * np.exp(-500 * prior)).T, 0.8), "reco_restart_walk": (p, 0.5),
        "reco_restart_walk_bn": (rows_to_one(t), 0.5), "reco_biased_walk": (biased(p, prior), 0.5), "reco_paths": (0.5 * t * np.exp(-0.9 * prior / prior.max()), 0),
    }[name]
    got = {}
    for r in catalogue.QUERIES[f"{name}_parts"](spark, SF).collect():
        got.setdefault(r.basket, []).append((r["rank"], r.item, r.score))
    assert set(got) == set(baskets)
    for b, known in baskets.items():
        start = np.zeros(len(items))
        start[known] = 1
        s = between(known, edges) if name == "reco_paths" else walk(start, edges, alpha)
        s[known] = 0
        best = np.sort(s)[::-1][:10]
        rows = sorted(got[b])
        assert len({i for _, i, _ in rows}) == len(rows) == 10
        assert np.allclose([x for *_, x in rows], best, rtol=0, atol=2e-6) and np.allclose([s[items.index(i)] for _, i, _ in rows], best, rtol=0, atol=2e-9)


def test_topics(spark, dense):
    users, items, w, _ = dense
    z = np.arange(3)
    pw = (1 + (np.array(items)[:, None] * 31 + z * 17) % 7).astype(float)
    pd = (1 + (np.array(users)[:, None] * 13 + z * 29) % 11).astype(float)
    pw, pd, pz = pw / pw.sum(0), pd / pd.sum(0), np.ones(3) / 3
    for _ in range(5):
        q = pz * pd[:, None, :] * pw[None, :, :]
        n = w[:, :, None] * q / q.sum(2, keepdims=True)
        pw, pd, pz = n.sum(0) / n.sum((0, 1)), n.sum(1) / n.sum((0, 1)), n.sum((0, 1)) / n.sum()
    got = catalogue.QUERIES["plsa_words_parts"](spark, SF).collect()
    assert len(got) == 3 * len(items) and np.allclose([r.p for r in got], [pw[items.index(r.item), r.z] for r in got], rtol=0, atol=2e-6)


def test_possible_items_hold_the_first_of_every_weighting():
    from trolley.operators import topics

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((900, 3)).round(2) * 1e-6, np.tile(rng.random((1, 3)) * 1e-6, (60, 1)), np.zeros((40, 3))])
    x[:300] += rng.random((300, 3)) * 2e-9
    ids = rng.permutation(1000)
    kept = set(topics.possible(x, ids, 12).tolist())
    assert len(kept) < 400
    for w in [np.eye(3)[0], np.eye(3)[2], *rng.dirichlet([0.5] * 3, 200)]:
        s = (w[0] * x[:, 0] + w[1] * x[:, 1] + w[2] * x[:, 2]).round(9)
        assert set(np.lexsort((-ids, -s))[:12].tolist()) <= kept


def test_topics_recommend_without_all_pairs(spark, monkeypatch):
    """As many rows as items for a basket are scored only where all are ranked; the recommendations are the same."""
    from trolley.functions.models import Topics
    from trolley.operators import ranking, topics

    rng = np.random.default_rng(9)
    ui = spark.createDataFrame(sorted({(int(c), int(i)) for c, i in zip(rng.integers(0, 60, 900), rng.integers(0, 200, 900))}), "customer bigint, item bigint").withColumn("w", F.lit(1.0))
    baskets = spark.createDataFrame(sorted({(int(b), int(i)) for b, i in zip(rng.integers(0, 30, 90), rng.integers(0, 200, 90))}), "basket bigint, item bigint").join(ui.select("item").distinct(), "item", "left_semi")
    model = Topics(3, 2).fit(ui)
    key = lambda df: sorted((r.basket, r["rank"], r.item, round(r.score, 9)) for r in df.collect())
    want = key(ranking.ranked(ranking.without_evidence(model.scores(baskets), baskets), 4))
    monkeypatch.setattr(topics, "HELD", 40)
    monkeypatch.setattr(topics, "folded_scores", None)
    assert want and key(model.recommend(baskets, 4)) == want
