"""Recommender models: train once on the user-item table, then score baskets (basket, item) in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels, ranking, topics, walks
from ..operators.statistics import item_stats


@dataclass
class Recommender:
    """Base: ``fit`` makes what scoring needs; ``scores`` gives (basket, item, score)."""

    def fit(self, ui: DataFrame) -> Recommender:
        self.ui, self.stats = ui, item_stats(ui)
        return self

    def scores(self, evidence: DataFrame) -> DataFrame:
        raise NotImplementedError

    def recommend(self, evidence: DataFrame, n: int = 10, kind: str = "all") -> DataFrame:
        """The n best for every basket; ``novel`` keeps items less popular than all of the basket."""
        scores = ranking.without_evidence(self.scores(evidence), evidence)
        scores = ranking.novel(scores, evidence, self.stats) if kind == "novel" else scores
        return ranking.ranked(scores, n)

    def recommend_all(self, evidence: DataFrame, n: int = 10, kind: str = "all") -> DataFrame:
        """basket, items: the n best in order for every basket; an empty list for baskets of fewer than n items."""
        found = self.recommend(ranking.of_size(evidence, n), n, kind)
        lists = found.groupBy("basket").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))  # n a basket
        empty = F.array().cast(f"array<{evidence.schema['item'].dataType.simpleString()}>")
        return evidence.select("basket").distinct().join(lists, "basket", "left").select("basket", F.coalesce("items", empty).alias("items"))


@dataclass
class Popularity(Recommender):
    def scores(self, evidence: DataFrame) -> DataFrame:
        return evidence.select("basket").distinct().crossJoin(self.stats.select("item", F.col("pop").alias("score")))

    def recommend(self, evidence: DataFrame, n: int = 10, kind: str = "all") -> DataFrame:
        if kind == "all" and n >= 0:
            return ranking.ranked(ranking.popularity_scores(evidence, self.stats, n), n)
        return super().recommend(evidence, n, kind)


@dataclass
class Additive(Recommender):
    """Sums of item-to-item weights: cooccurrence, cosine or conditional."""

    kernel: str = "cooccurrence"
    alpha: float = 0.5

    def fit(self, ui: DataFrame) -> Recommender:
        super().fit(ui)
        make = {"cooccurrence": kernels.cooccurrence, "cosine": kernels.cosine, "conditional": lambda x: kernels.conditional(x, self.alpha)}
        self.edges = make[self.kernel](ui)
        return self

    def scores(self, evidence: DataFrame) -> DataFrame:
        return ranking.additive_scores(evidence, self.edges)


@dataclass
class Marginal(Recommender):
    """The conditional variant whose weight depends on the scored item alone."""

    alpha: float = 0.5

    def scores(self, evidence: DataFrame) -> DataFrame:
        sizes = evidence.groupBy("basket").agg(F.count("*").alias("k"))
        return sizes.crossJoin(kernels.marginal(self.ui, self.alpha)).select("basket", "item", (F.col("k") * F.col("w")).alias("score"))

    def recommend(self, evidence: DataFrame, n: int = 10, kind: str = "all") -> DataFrame:
        if kind == "all" and n >= 0:
            return ranking.ranked(ranking.weight_scores(evidence, kernels.marginal(self.ui, self.alpha), n), n)
        return super().recommend(evidence, n, kind)


@dataclass
class Walk(Recommender):
    """Walks from a basket. kind: basket, basket_pop, restart, biased. graph: bn (purchase graph) or cos."""

    kind: str = "restart"
    alpha: float = 0.5
    theta: float = 1.0
    graph: str = "bn"
    steps: int = 10

    def fit(self, ui: DataFrame) -> Recommender:
        super().fit(ui)
        if self.kind.startswith("basket"):
            t = kernels.transition(ui)
            self.edges = kernels.damped(t, self.stats, 500.0) if self.kind == "basket_pop" else t
            return self
        base = kernels.to_probability(kernels.transition(ui) if self.graph == "bn" else kernels.cooccurrence(ui))
        self.edges = kernels.biased(base, self.stats, self.theta) if self.kind == "biased" else base
        return self

    def scores(self, evidence: DataFrame) -> DataFrame:
        start = evidence.select(F.col("basket").alias("id"), "item", F.lit(1.0).alias("s"))
        walk = walks.basket_walk if self.kind.startswith("basket") else walks.restart_walk
        return walk(start, self.edges, self.alpha, self.steps).select(F.col("id").alias("basket"), "item", F.col("s").alias("score"))


@dataclass
class Paths(Recommender):
    """Sum over paths: betweenness of items on paths between evidence."""

    alpha: float = 0.5
    theta: float = 0.9
    steps: int = 10

    def fit(self, ui: DataFrame) -> Recommender:
        super().fit(ui)
        top = self.stats.agg(F.max("prior").alias("s"))
        self.edges = kernels.damped(kernels.transition(ui), self.stats, self.theta, top).withColumn("w", self.alpha * F.col("w"))
        return self

    def scores(self, evidence: DataFrame) -> DataFrame:
        return walks.path_betweenness(evidence.select(F.col("basket").alias("id"), "item"), self.edges, self.steps).select(F.col("id").alias("basket"), "item", F.col("s").alias("score"))


@dataclass
class Topics(Recommender):
    """pLSA: baskets are folded in, items scored by their chance under the basket's topics."""

    topics: int = 3
    steps: int = 5
    tolerance: float | None = None

    def fit(self, ui: DataFrame) -> Recommender:
        super().fit(ui)
        self.model = topics.train(ui, self.topics, self.steps, self.tolerance)
        return self

    def scores(self, evidence: DataFrame) -> DataFrame:
        return topics.folded_scores(self.documents(evidence), self.model, self.steps)

    def documents(self, evidence: DataFrame) -> DataFrame:
        return evidence.select(F.col("basket").alias("customer"), "item", F.lit(1.0).alias("w"))

    def recommend(self, evidence: DataFrame, n: int = 10, kind: str = "all") -> DataFrame:
        """Without pairs of every basket and item, unless all are ranked or the novel ones are chosen."""
        if kind == "novel" or n < 1:
            return super().recommend(evidence, n, kind)
        return ranking.ranked(topics.folded_best(self.documents(evidence), self.model, self.steps, n), n)


MODELS = {"popularity": Popularity, "additive": Additive, "marginal": Marginal, "walk": Walk, "paths": Paths, "paths_alias": Paths, "topics": Topics}
