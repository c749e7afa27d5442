"""Every query of the engine on the star tables, each beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, held, interactions, kernels, ranking, splits, statistics, topics, walks
from ..operators.blocks import Graph
from ..operators.lineage import cut
from ..sources import results as store
from ..sources.transactions import star_transactions
from . import oracles as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N, STEPS, POWER, TOPICS, ROUNDS = 3, 6, 5, 3, 3
#: On parts nothing is cut for the SQL's sake: places, steps, power iterations and rounds are the operators' defaults.
PART_N, PART_STEPS, PART_POWER, PART_TOPICS, PART_ROUNDS = 10, 10, 30, 3, 5


class Data:
    """The usual tables of a universe: training counts, statistics, test items."""

    def __init__(self, spark: SparkSession, sf_dir: str, universe: str = "brand"):
        self.spark, self.sf_dir, self.universe = spark, sf_dir, universe
        self.n, self.steps, self.power, self.topics, self.rounds = (PART_N, PART_STEPS, PART_POWER, PART_TOPICS, PART_ROUNDS) if universe == "part" else (N, STEPS, POWER, TOPICS, ROUNDS)
        self.tx = star_transactions(spark, sf_dir, universe)
        self.train, self.test = interactions.split_by_date(self.tx)
        self.ui = interactions.interactions(self.train)
        self.stats = statistics.item_stats(self.ui)
        self.items = interactions.basket_items(self.test, self.ui)

    def on_paths(self) -> Data:
        """Counts and test items as tables, as sums over paths read them several times."""
        self.ui = cut(self.ui)
        self.stats, self.items = statistics.item_stats(self.ui), cut(interactions.basket_items(self.test, self.ui))
        return self

    def cooccurrence(self, novel: bool = False) -> DataFrame | Graph:
        """On parts the paths, as their edges are nearly as many; on brands the edges."""
        return kernels.cooccurrence_paths(self.on_paths().ui, self.stats if novel else None) if self.universe == "part" else kernels.cooccurrence(self.ui)

    def kept(self, df: DataFrame) -> DataFrame:
        """Several branches or steps read it: written once."""
        return cut(df)


def query(name: str, sql: str | None, universe: str = "brand"):
    def register(f: Callable[[Data], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Data(spark, sf_dir, universe))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def on_parts(f: Callable[[Data], DataFrame]):
    """The query also on parts, as <name>_parts, with the brand query's SQL over parts."""
    for name in [k for k, run in QUERIES.items() if run.__wrapped__ is f]:
        sql = ORACLES[name].replace(o.base(), o.base("part"))
        query(f"{name}_parts", sql.replace(o.top(N), o.top(PART_N)) if name in ("reco_conditional", "reco_marginal") else sql, "part")(f)
    return f


def without_sql(f: Callable[[Data], DataFrame]):
    """The query also on parts, as <name>_parts: unrolled steps are too slow in SQL there, tests compare with dense arrays."""
    for name in [k for k, run in QUERIES.items() if run.__wrapped__ is f]:
        query(f"{name}_parts", None, "part")(f)
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def ranks(df: DataFrame) -> DataFrame:
    return df.select("basket", "item", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# interactions and baskets


@query("ui_counts", o.q(o.base("part"), "SELECT customer, item, CAST(w AS BIGINT) AS n FROM ui"), "part")
def ui_counts(d):
    return d.ui.select("customer", "item", F.col("w").cast("bigint").alias("n"))


@query("ui_log", o.q(o.base("part"), "SELECT customer, item, round(ln(w + 1), 6) AS w FROM ui"), "part")
def ui_log(d):
    return rounded(interactions.interactions(d.train, "log"), "w")


@on_parts
@query("ui_binary", o.q(o.base(), "SELECT customer, item, CAST(1 AS DOUBLE) AS w FROM ui"))
def ui_binary(d):
    return interactions.interactions(d.train, "binary")


@query("date_split", o.q(o.base("part"), f"SELECT day < {o.CUTOFF} AS is_train, count(*) AS n FROM tx GROUP BY day < {o.CUTOFF}"), "part")
def date_split(d):
    return d.train.select(F.lit(True).alias("is_train")).unionByName(d.test.select(F.lit(False).alias("is_train"))).groupBy("is_train").agg(F.count("*").alias("n"))


def basket_sql(key: str, universe: str = "part") -> str:
    return o.q(o.base(universe), f"t AS (SELECT DISTINCT {key}, item FROM tx WHERE day >= {o.CUTOFF})", f"SELECT {', '.join('t.' + k for k in key.split(', '))}, count(v.item) AS n, coalesce(string_agg(CAST(v.item AS VARCHAR), ',' ORDER BY v.item), '') AS items FROM t LEFT JOIN stats v ON t.item = v.item GROUP BY {', '.join('t.' + k for k in key.split(', '))}")


def flat(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key, F.size("items").cast("bigint").alias("n"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("baskets_by_order", basket_sql("basket"), "part")
def baskets_by_order(d):
    return flat(interactions.baskets(d.test, d.ui, "basket"), "basket")


@query("baskets_by_day_customer", basket_sql("day, customer"), "part")
def baskets_by_day(d):
    return flat(interactions.baskets(d.test, d.ui, "day", "customer"), "day", "customer")


@on_parts
@query("baskets_by_customer", basket_sql("customer", "brand"))
def baskets_by_customer(d):
    return flat(interactions.baskets(d.test, d.ui, "customer"), "customer")


@query("basket_items", o.q(o.base("part"), "SELECT basket, item FROM bi"), "part")
def basket_items(d):
    return d.items


@query("first_baskets", o.q(o.base("part"), "SELECT basket, item FROM bi WHERE basket IN (SELECT DISTINCT basket FROM bi ORDER BY basket LIMIT 100)"), "part")
def first_baskets(d):
    return ranking.first_baskets(d.items, 100)


# statistics


@query("item_stats", o.q(o.base("part"), "SELECT item, CAST(pop AS BIGINT) AS pop, round(prior, 9) AS prior, users FROM stats"), "part")
def item_stats(d):
    return d.stats.select("item", F.col("pop").cast("bigint").alias("pop"), F.round("prior", 9).alias("prior"), "users")


@query("cardinalities", o.q(o.base("part"), "SELECT count(DISTINCT customer) AS n_users, count(DISTINCT item) AS n_items FROM ui"), "part")
def cardinalities(d):
    return statistics.cardinalities(d.ui)


CELLS = "c AS (SELECT sum(w) AS s, sum(w * w) AS q, max(w) AS mx, count(DISTINCT customer) * count(DISTINCT item) AS n FROM ui)"


@query("cell_stats", o.q(o.base("part"), CELLS, "SELECT round(s / n, 6) AS mean, round(sqrt(q / n - (s / n) * (s / n)), 6) AS std, mx AS max FROM c"), "part")
def cell_stats(d):
    return rounded(statistics.cell_stats(d.ui), "mean", "std")


@query("mean_of_top_priors", o.q(o.base("part"), "SELECT round(avg(prior), 9) AS m FROM (SELECT prior FROM stats ORDER BY prior DESC, item DESC LIMIT 10) z"), "part")
def top_priors(d):
    return statistics.mean_of_top_priors(d.stats).select(F.round("m", 9).alias("m"))


@query("row_normalised", o.q(o.base("part"), o.NUI, "SELECT customer, item, round(w, 6) AS w FROM nui"), "part")
def row_normalised(d):
    return rounded(statistics.row_normalised(d.ui), "w")


@query("tf", o.q(o.base("part"), "SELECT u.customer, u.item, round(u.w / r.n, 6) AS tf FROM ui u JOIN (SELECT customer, count(*) AS n FROM ui GROUP BY customer) r ON u.customer = r.customer"), "part")
def tf(d):
    return rounded(statistics.tf(d.ui), "tf")


@query("idf", o.q(o.base("part"), "n AS (SELECT count(DISTINCT customer) AS n FROM ui)", "SELECT item, round(ln(CAST(n AS DOUBLE) / users), 6) AS idf FROM stats CROSS JOIN n"), "part")
def idf(d):
    return rounded(statistics.idf(d.ui), "idf")


@query("idf_whole", o.q(o.base("part"), "n AS (SELECT count(DISTINCT customer) AS n FROM ui)", "SELECT item, round(ln(floor(CAST(n AS DOUBLE) / users)), 6) AS idf FROM stats CROSS JOIN n"), "part")
def idf_whole(d):
    return rounded(statistics.idf(d.ui, whole=True), "idf")


@query("nnz", o.q(o.base("part"), "SELECT customer, count(*) AS nnz FROM ui WHERE w <> 0 GROUP BY customer"), "part")
def nnz(d):
    return statistics.nnz(d.ui, "customer")


@on_parts
@query("normalised_by_mean", o.q(o.base(), CELLS, "SELECT customer, item, round(w / (s / n), 6) AS w FROM ui CROSS JOIN c"))
def by_mean(d):
    return rounded(statistics.normalised_by_mean(d.ui), "w")


@on_parts
@query("standardised", o.q(o.base(), "n AS (SELECT CAST(count(DISTINCT customer) AS DOUBLE) AS n FROM ui)", "c AS (SELECT item, sum(w) / max(n) AS m, sqrt(sum(w * w) / max(n) - (sum(w) / max(n)) * (sum(w) / max(n))) AS d FROM ui CROSS JOIN n GROUP BY item)", "SELECT u.customer, u.item, round((u.w - c.m) / c.d, 6) AS z FROM ui u JOIN c ON u.item = c.item"))
def standardised(d):
    return rounded(statistics.standardised(d.ui), "z")


# kernels

EDGE = "SELECT src, dst, round(w, 6) AS w FROM {}"


@query("cooccurrence_edges_parts", o.q(o.base("part"), o.COOC, EDGE.format("edges")), "part")
@query("cooccurrence", o.q(o.base(), o.COOC, EDGE.format("edges")))
def cooccurrence(d):
    return rounded(kernels.cooccurrence(d.ui), "w")


@query("cooccurrence_parts", o.q(o.base("part"), o.COOC, "SELECT src, count(*) AS n, sum(CAST(w AS BIGINT)) AS w FROM edges GROUP BY src").replace("sum(CAST(w AS BIGINT))", "CAST(sum(w) AS BIGINT)"), "part")
def cooccurrence_parts(d):
    return kernels.cooccurrence(d.ui).groupBy("src").agg(F.count("*").alias("n"), F.sum("w").cast("bigint").alias("w"))


@on_parts
@query("cosine", o.q(o.base(), o.COOC_ALL, "SELECT e.src, e.dst, round(e.w / sqrt(a.w * b.w), 6) AS w FROM dense e JOIN dense a ON a.src = e.src AND a.dst = e.src JOIN dense b ON b.src = e.dst AND b.dst = e.dst"))
def cosine(d):
    return kernels.cosine_paths(d.on_paths().ui).edges(True, places=6) if d.universe == "part" else rounded(kernels.cosine(d.ui), "w")


@on_parts
@query("conditional", o.q(o.base(), o.COND, EDGE.format("edges")))
def conditional(d):
    return kernels.conditional_paths(d.on_paths().ui).edges(True, places=6) if d.universe == "part" else rounded(kernels.conditional(d.ui), "w")


MARGINAL = "mg AS (SELECT n.item, sum(n.w) / pow(max(s.pop), 1.5) AS w FROM nui n JOIN stats s ON n.item = s.item GROUP BY n.item)"


@on_parts
@query("marginal", o.q(o.base(), o.NUI, MARGINAL, "SELECT item, round(w, 9) AS w FROM mg"))
def marginal(d):
    return kernels.marginal(d.ui).select("item", F.round("w", 9).alias("w"))


@query("root_distance", o.q(o.base(), o.COOC_ALL, "SELECT a.src, b.src AS dst, round(sqrt(greatest(0.0, a.w + b.w - 2 * coalesce(e.w, 0.0))), 6) AS w FROM dense a JOIN dense b ON a.src = a.dst AND b.src = b.dst LEFT JOIN dense e ON e.src = a.src AND e.dst = b.src"))
def root_distance(d):
    return rounded(kernels.root_distance(kernels.cooccurrence(d.ui, True), d.stats.select("item")), "w")


@on_parts
@query("transition", o.q(o.base(), o.TRANS, EDGE.format("t")))
def transition(d):
    return kernels.transition_paths(d.on_paths().ui).edges(places=6) if d.universe == "part" else rounded(kernels.transition(d.ui), "w")


@on_parts
@query("transition_column_sums", o.q(o.base(), "SELECT item AS dst, CAST(1.0 AS DOUBLE) AS w FROM stats"))
def column_sums(d):
    return kernels.transition(d.ui, True).groupBy("dst").agg(F.round(F.sum("w"), 6).alias("w"))


@on_parts
@query("to_probability", o.q(o.base(), o.COOC, o.PROB, EDGE.format("p")))
def to_probability(d):
    return kernels.probability_paths(d.on_paths().ui).edges(places=6) if d.universe == "part" else rounded(kernels.to_probability(kernels.cooccurrence(d.ui)), "w")


@without_sql
@query("biased_transition", o.q(o.base(), o.COOC, o.PROB, o.biased(1.0, POWER), EDGE.format("bp")))
def biased(d):
    paths = kernels.biased_paths(d.on_paths().ui, d.stats, 1.0, d.power) if d.universe == "part" else None
    if paths is not None:
        return paths.edges(places=6)
    return rounded(kernels.biased(d.kept(kernels.to_probability(kernels.cooccurrence(d.ui))), d.kept(d.stats), 1.0, d.power), "w")


# recommendations


@query("reco_cooccurrence", o.q(o.base("part"), o.COOC, o.scored(), o.top(10), o.RECO), "part")
def reco_cooccurrence(d):
    edges = d.cooccurrence()
    return ranks(ranking.recommend(d.items, edges, 10))


@on_parts
@query("reco_full_ranking", o.q(o.base(), o.COOC, o.scored(), o.top(1000), o.RECO))
def reco_full(d):
    edges = d.cooccurrence()
    return ranks(ranking.recommend(d.items, edges, 1000))  # the SQL's places


@query("reco_popularity", o.q(o.base("part"), "place AS (SELECT item, pop, row_number() OVER (ORDER BY pop DESC, item DESC) AS place FROM stats)", "scores AS (SELECT a.basket, p.item, p.pop AS score FROM (SELECT basket, count(*) AS k FROM bi GROUP BY basket) a JOIN place p ON p.place <= a.k + 10 LEFT JOIN bi b ON a.basket = b.basket AND p.item = b.item WHERE b.item IS NULL)", o.top(10), o.RECO), "part")
def reco_popularity(d):
    return ranks(ranking.ranked(ranking.popularity_scores(d.items, d.stats, 10), 10))


@on_parts
@query("reco_conditional", o.q(o.base(), o.COND, o.scored(), o.top(N), o.RECO))
def reco_conditional(d):
    edges = kernels.conditional_sums(d.on_paths().ui) if d.universe == "part" else kernels.conditional(d.ui)
    return ranks(ranking.recommend(d.items, edges, d.n))


@on_parts
@query("reco_marginal", o.q(o.base(), o.NUI, MARGINAL, "scores AS (SELECT a.basket, m.item, a.k * m.w AS score FROM (SELECT basket, count(*) AS k FROM bi GROUP BY basket) a CROSS JOIN mg m LEFT JOIN bi b ON a.basket = b.basket AND m.item = b.item WHERE b.item IS NULL)", o.top(N), o.RECO))
def reco_marginal(d):
    from ..functions.models import Marginal

    return ranks(Marginal().fit(d.ui).recommend(d.items, d.n))


@query("reco_novel", o.q(o.base("part"), o.COOC, o.scored(), o.NOVEL.format(e="bi"), o.top(10, "fresh"), o.RECO), "part")
def reco_novel(d):
    scores = ranking.cooccurrence_scores(d.items, d.ui, d.stats)  # evidence is never less popular than itself
    return ranks(ranking.ranked(scores, 10))


def starts(d: Data) -> DataFrame:
    """Brands: each item. Parts: the baskets, which are fewer than the parts."""
    if d.universe == "part":
        d.items = d.kept(d.items)
        return d.items.select(F.col("basket").alias("id"), "item", F.lit(1.0).alias("s"))
    return d.stats.select(F.col("item").alias("id"), "item", F.lit(1.0).alias("s"))


def walked(d: Data, reach: DataFrame) -> DataFrame:
    """Walks are linear: those from each item of a basket add up."""
    if d.universe == "part":
        scores = reach.select(F.col("id").alias("basket"), "item", F.col("s").alias("score"))
        return ranks(ranking.ranked(ranking.without_evidence(scores, d.items), d.n))
    return ranks(ranking.recommend(d.items, reach.select(F.col("id").alias("src"), F.col("item").alias("dst"), F.col("s").alias("w")), N))


def held_walk(d: Data, prepare: Callable[[held.Held], None], score: Callable) -> DataFrame | None:
    """On parts, where the counts fit a task: without edges; else none, and edges are stepped over."""
    if d.universe != "part" or not held.fits(d.on_paths().ui):
        return None
    return ranks(ranking.ranked(held.recommend(d.items, d.ui, prepare, score, d.n), d.n))


def transitions(h: held.Held) -> None:
    h.transition()


def transitions_damped(h: held.Held) -> None:
    h.transition()
    h.damped(500.0)


def transition_probabilities(h: held.Held) -> None:
    h.transition()
    h.probability()


def cooccurrence_probabilities(h: held.Held) -> None:
    h.probability()


def biased_probabilities(h: held.Held) -> None:
    h.probability()
    h.biased(1.0, PART_POWER)


def path_weights(h: held.Held) -> None:
    h.transition()
    h.damped(0.9 / h.most)
    h.v *= 0.5


def walk_sql(alpha: float, edges: str, *before: str, back: bool = False) -> str:
    return o.q(o.base(), *before, o.EACH, o.walk("each_item", edges, alpha, STEPS, back), o.summed(STEPS), o.top(N), o.RECO)


@without_sql
@query("reco_basket_walk", walk_sql(0.8, "t", o.TRANS, back=True))
def reco_basket_walk(d):
    found = held_walk(d, transitions, held.walk(0.8, d.steps, back=True))
    if found is not None:
        return found
    return walked(d, walks.basket_walk(starts(d), d.kept(kernels.transition(d.ui)), 0.8, d.steps))


@without_sql
@query("reco_basket_walk_pop", walk_sql(0.8, "tp", o.TRANS, "tp AS (SELECT t.src, t.dst, t.w * exp(-500.0 * s.prior) AS w FROM t JOIN stats s ON t.dst = s.item)", back=True))
def reco_basket_walk_pop(d):
    found = held_walk(d, transitions_damped, held.walk(0.8, d.steps, back=True))
    if found is not None:
        return found
    return walked(d, walks.basket_walk(starts(d), d.kept(kernels.damped(kernels.transition(d.ui), d.stats, 500.0)), 0.8, d.steps))


@without_sql
@query("reco_restart_walk", walk_sql(0.5, "p", o.COOC, o.PROB))
def reco_restart_walk(d):
    found = held_walk(d, cooccurrence_probabilities, held.walk(0.5, d.steps))
    if found is not None:
        return found
    return walked(d, walks.restart_walk(starts(d), d.kept(kernels.to_probability(kernels.cooccurrence(d.ui))), 0.5, d.steps))


@without_sql
@query("reco_restart_walk_bn", walk_sql(0.5, "p", o.TRANS, o.PROB.replace("edges", "t")))
def reco_restart_walk_bn(d):
    found = held_walk(d, transition_probabilities, held.walk(0.5, d.steps))
    if found is not None:
        return found
    return walked(d, walks.restart_walk(starts(d), d.kept(kernels.to_probability(kernels.transition(d.ui))), 0.5, d.steps))


@without_sql
@query("reco_biased_walk", walk_sql(0.5, "bp", o.COOC, o.PROB, o.biased(1.0, POWER)))
def reco_biased_walk(d):
    found = held_walk(d, biased_probabilities, held.walk(0.5, d.steps))
    if found is not None:
        return found
    base = d.kept(kernels.to_probability(kernels.cooccurrence(d.ui)))
    return walked(d, walks.restart_walk(starts(d), d.kept(kernels.biased(base, d.kept(d.stats), 1.0, d.power)), 0.5, d.steps))


@without_sql
@query("reco_paths", o.q(o.base(), o.TRANS, o.paths(0.5, 0.9, 4), "scores AS (SELECT a.basket, a.item, a.s * b.s / z.z AS score FROM zf a JOIN zb b ON a.basket = b.basket AND a.item = b.item JOIN z ON a.basket = z.basket LEFT JOIN bi e ON a.basket = e.basket AND a.item = e.item WHERE e.item IS NULL)", o.top(N), o.RECO))
def reco_paths(d):
    found = held_walk(d, path_weights, held.between(PART_STEPS))
    if found is not None:
        return found
    top = d.stats.agg(F.max("prior").alias("s"))
    edges = d.kept(kernels.damped(kernels.transition(d.ui), d.stats, 0.9, top).withColumn("w", 0.5 * F.col("w")))
    items = d.kept(d.items)
    found = walks.path_betweenness(items.select(F.col("basket").alias("id"), "item"), edges, PART_STEPS if d.universe == "part" else 4)
    return ranks(ranking.ranked(found.select(F.col("id").alias("basket"), "item", F.col("s").alias("score")), d.n))


# topics

FACTORS = o.plsa(TOPICS, ROUNDS)


def trained(d: Data) -> topics.Plsa:
    d.ui = d.kept(d.ui)
    return topics.train(d.ui, d.topics, d.rounds)


@without_sql
@query("plsa_words", o.q(o.base(), FACTORS, f"SELECT item, z, round(p, 6) AS p FROM w{ROUNDS}"))
def plsa_words(d):
    return rounded(trained(d).p_w, "p")


@without_sql
@query("plsa_documents", o.q(o.base(), FACTORS, f"SELECT customer, z, round(p, 6) AS p FROM d{ROUNDS}"))
def plsa_documents(d):
    return rounded(trained(d).p_d, "p")


@without_sql
@query("plsa_log_likelihood", o.q(o.base(), FACTORS, f"SELECT round(sum(w * ln(q)), 3) AS value FROM (SELECT u.customer, u.item, u.w, sum(c.p * a.p * b.p) AS q FROM ui u JOIN w{ROUNDS} a ON u.item = a.item JOIN d{ROUNDS} b ON u.customer = b.customer AND a.z = b.z JOIN z{ROUNDS} c ON a.z = c.z GROUP BY u.customer, u.item, u.w) x WHERE q > 0"))
def plsa_likelihood(d):
    return topics.log_likelihood(d.ui, trained(d)).select(F.round("value", 3).alias("value"))


@without_sql
@query("plsa_topics_of_documents", o.q(o.base(), FACTORS, f"SELECT customer, z, round(p / sum(p) OVER (PARTITION BY customer), 6) AS p FROM (SELECT d.customer, d.z, d.p * c.p AS p FROM d{ROUNDS} d JOIN z{ROUNDS} c ON d.z = c.z) x"))
def plsa_topics(d):
    m = trained(d)
    return rounded(topics.topics_of(m.p_d, m.p_z, "customer"), "p")


@without_sql
@query("plsa_word_clusters", o.q(o.base(), FACTORS, f"SELECT item, z FROM (SELECT item, z, row_number() OVER (PARTITION BY item ORDER BY round(p, 12) DESC, z) AS r FROM (SELECT w.item, w.z, w.p * c.p / sum(w.p * c.p) OVER (PARTITION BY w.item) AS p FROM w{ROUNDS} w JOIN z{ROUNDS} c ON w.z = c.z) x) y WHERE r = 1"))
def plsa_clusters(d):
    m = trained(d)
    return topics.cluster_of(topics.topics_of(m.p_w, m.p_z, "item"), "item")


@without_sql
@query("plsa_topic_labels", o.q(o.base(), FACTORS, f"SELECT z, item, CAST(r AS BIGINT) AS rank FROM (SELECT z, item, row_number() OVER (PARTITION BY z ORDER BY round(p, 12) DESC, item DESC) AS r FROM w{ROUNDS}) x WHERE r <= 10"))
def plsa_labels(d):
    return topics.topic_labels(trained(d).p_w).withColumn("rank", F.col("rank").cast("bigint"))


@without_sql
@query("plsa_smoothed", o.q(o.base(), FACTORS, f"SELECT u.customer, u.item, round(sum(a.p * b.p), 9) AS p FROM ui u JOIN w{ROUNDS} a ON u.item = a.item JOIN d{ROUNDS} b ON u.customer = b.customer AND a.z = b.z GROUP BY u.customer, u.item"))
def plsa_smoothed(d):
    return topics.smoothed(d.ui, trained(d)).select("customer", "item", F.round("p", 9).alias("p"))


@without_sql
@query("plsa_global_weights", o.q(o.base(), FACTORS, f"SELECT w.z, round(sum(s.prior * w.p), 9) AS value FROM w{ROUNDS} w JOIN stats s ON w.item = s.item GROUP BY w.z"))
def plsa_weights(d):
    return topics.global_weights(trained(d).p_w, d.stats.select("item", F.col("prior").alias("gw"))).select("z", F.round("value", 9).alias("value"))


@without_sql
@query("reco_plsa", None)
def reco_plsa(d):
    from ..functions.models import Topics

    return ranks(Topics(d.topics, d.rounds).fit(d.kept(d.ui)).recommend(d.items, d.n))


@query("lsa_smoothed", None)
def lsa_smoothed(d):
    return rounded(topics.lsa_smoothed(d.ui, topics.lsa(d.ui, 5)), "p")


# metrics


@on_parts
@query("metric_rare_item_hit", o.pop_hit(N))
def metric_pop(d):
    edges = d.cooccurrence(novel=True)
    return evaluation.rare_item_hit(d.items, edges, d.stats, N)


@on_parts
@query("metric_shuffled_hit", o.rnd_hit(N))
def metric_rnd(d):
    edges = d.cooccurrence()
    return evaluation.shuffled_hit(d.items, edges, N)


@on_parts
@query("metric_leave_one_out", o.whr(N))
def metric_whr(d):
    edges = d.cooccurrence()
    return rounded(evaluation.weighted_leave_one_out(d.items, edges, d.stats, N), "value")


@on_parts
@query("metric_novelty", o.novelty(N))
def metric_novelty(d):
    edges = d.cooccurrence()
    return rounded(evaluation.novelty(d.items, edges, d.stats, N, statistics.mean_of_top_priors(d.stats)), "value")


@on_parts
@query("metric_mean_prior", o.q(o.base(), o.COOC, o.scored(), o.top(N), "SELECT b.basket, round(avg(s.prior), 6) AS value FROM best b JOIN stats s ON b.item = s.item GROUP BY b.basket"))
def metric_prior(d):
    edges = d.cooccurrence()
    return rounded(evaluation.mean_prior(ranking.recommend(d.items, edges, N), d.stats), "value")


@on_parts
@query("mean_performance", o.q(o.base(), o.COOC, o.eligible(N), o.hidden(o.SHUFFLE, N), o.scored("ev"), o.top(N), o.hit("m"), "SELECT 'shuffled_hit' AS metric, round(sum(value) / (SELECT count(DISTINCT basket) FROM bi), 6) AS mean, round(avg(value), 6) AS mean_eligible FROM m"))
def mean_performance(d):
    edges = d.cooccurrence()
    return rounded(evaluation.mean_performance({"shuffled_hit": evaluation.shuffled_hit(d.items, edges, N)}, d.items), "mean", "mean_eligible")


@query("least_popular_items", o.q(o.base("part"), "SELECT basket, item FROM (SELECT b.basket, b.item, row_number() OVER (PARTITION BY b.basket ORDER BY s.pop, b.item) AS r FROM bi b JOIN stats s ON b.item = s.item) x WHERE r <= 3"), "part")
def least_popular(d):
    return ranking.least_popular(d.items, d.stats, N)


# splits, grids, results


@query("folds", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS BIGINT) AS fold FROM orders")
def folds(d):
    rows = d.spark.read.parquet(f"{d.sf_dir}/orders.parquet").select("o_orderkey")
    return splits.folds(rows, "o_orderkey", 5).select("o_orderkey", "fold")


@query("split_ratio", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) >= round(0.75 * (SELECT count(*) FROM orders)) AS is_test FROM orders")
def split_ratio(d):
    rows = d.spark.read.parquet(f"{d.sf_dir}/orders.parquet").select("o_orderkey")
    return splits.split_ratio(rows, "o_orderkey").select("o_orderkey", "is_test")


@query("best_of_grid", "SELECT o_custkey AS customer, o_orderkey AS basket, o_totalprice AS price FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) x WHERE r = 1")
def best_of_grid(d):
    rows = d.spark.read.parquet(f"{d.sf_dir}/orders.parquet").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("basket"), F.col("o_totalprice").alias("price"))
    return splits.best(rows.withColumn("_o", F.struct("price", "basket")), "_o", "customer").drop("_o")


@query("result_store", "SELECT o_orderkey AS result_id, l_returnflag AS performance, CAST(l_quantity AS DOUBLE) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def result_store(d):
    orders, lines = (d.spark.read.parquet(f"{d.sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    tables = store.empty_store(d.spark)
    tables["models"] = store.get_or_create(tables["models"], orders.select(F.col("o_orderpriority").alias("label")))
    tables["performances"] = store.get_or_create(tables["performances"], lines.select(F.col("l_returnflag").alias("label")))
    models, names = tables["models"].withColumnRenamed("id", "model_id"), tables["performances"].withColumnRenamed("id", "performance_id")
    tables["results"] = orders.join(models, F.col("o_orderpriority") == F.col("label")).select(F.col("o_orderkey").alias("id"), "model_id")
    tables["result_performance"] = lines.join(names, F.col("l_returnflag") == F.col("label")).select(F.col("l_orderkey").alias("result_id"), "performance_id", F.col("l_quantity").alias("value"))
    return store.results_of(tables, orders.agg(F.min("o_orderpriority")).first()[0])


@query("term_counts", r"SELECT customer, term, CAST(count(*) AS DOUBLE) AS w FROM (SELECT doc_id AS customer, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+')) AS term FROM documents) WHERE term <> '' GROUP BY customer, term")
def term_counts(d):
    return topics.term_counts(d.spark.read.parquet(f"{d.sf_dir}/documents.parquet"))


@query("event_counts", "SELECT user_id AS customer, event_type AS item, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY user_id, event_type")
def event_counts(d):
    from ..streaming.counts import running_counts

    return running_counts(d.spark.read.parquet(f"{d.sf_dir}/events.parquet"))
