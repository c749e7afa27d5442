"""Item graphs (src, dst, w) from the user-item table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Graph
from .lineage import cut
from .statistics import row_normalised

#: Items of which the driver and every task may hold a few values.
ITEMS = 2_000_000


def two_hop(left: DataFrame, right: DataFrame, diagonal: bool, over: Column | None = None) -> DataFrame:
    """Sum over customers of left w times right w, over a column of right: the sparse product, summed in part before it is shuffled."""
    a = left.select("customer", F.col("item").alias("src"), F.col("w").alias("wa"))
    b = right.withColumnsRenamed({"item": "dst", "w": "wb"})
    pairs = a.join(b, "customer")
    pairs = pairs if diagonal else pairs.where("src <> dst")
    each = F.col("wa") * F.col("wb")
    return pairs.groupBy("src", "dst").agg(F.sum(each if over is None else each / over).alias("w"))


def cooccurrence(ui: DataFrame, diagonal: bool = False) -> DataFrame:
    return two_hop(ui, ui, diagonal)


def norms(ui: DataFrame) -> DataFrame:
    return ui.groupBy("item").agg(F.sum(F.col("w") * F.col("w")).alias("q"))


def with_ends(edges: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Edges with a value of the item at either end, as <name>_src and <name>_dst."""
    src = values.select(F.col("item").alias("src"), F.col(name).alias(f"{name}_src"))
    dst = values.select(F.col("item").alias("dst"), F.col(name).alias(f"{name}_dst"))
    return edges.join(src, "src").join(dst, "dst")


def cosine(ui: DataFrame) -> DataFrame:
    edges = with_ends(cooccurrence(ui, diagonal=True), norms(ui), "q")
    return edges.select("src", "dst", (F.col("w") / F.sqrt(F.col("q_src") * F.col("q_dst"))).alias("w"))


def binary(ui: DataFrame) -> DataFrame:
    return ui.select("customer", "item", F.lit(1.0).alias("w"))


def conditional(ui: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Customers of both over those of src times those of dst to the power alpha; the diagonal stays."""
    one = binary(ui)
    edges = with_ends(cooccurrence(one, diagonal=True), norms(one), "q")
    return edges.select("src", "dst", (F.col("w") / (F.col("q_src") * F.pow("q_dst", F.lit(alpha)))).alias("w"))


def marginal(ui: DataFrame, alpha: float = 0.5) -> DataFrame:
    """item, w: the variant of ``conditional`` that does not depend on src."""
    a = row_normalised(ui).groupBy("item").agg(F.sum("w").alias("a"))
    c = ui.groupBy("item").agg(F.sum("w").alias("c"))
    return a.join(c, "item").select("item", (F.col("a") / F.pow("c", F.lit(1 + alpha))).alias("w"))


def root_distance(edges: DataFrame, items: DataFrame) -> DataFrame:
    """sqrt(w_ii + w_jj - 2 w_ij) over all pairs of ``items``: dense by definition, for small universes."""
    own = edges.where("src = dst").select(F.col("src").alias("item"), F.col("w").alias("q"))
    grid = items.select(F.col("item").alias("src")).crossJoin(items.select(F.col("item").alias("dst")))
    x = with_ends(grid.join(edges, ["src", "dst"], "left"), own, "q")
    return x.select("src", "dst", F.sqrt(F.greatest(F.lit(0.0), F.col("q_src") + F.col("q_dst") - 2 * F.coalesce("w", F.lit(0.0)))).alias("w"))


def transition(ui: DataFrame, diagonal: bool = False) -> DataFrame:
    """Walk item - customer - item on the purchase graph; columns sum to one with the diagonal."""
    sums = ui.groupBy("item").agg(F.sum("w").alias("c"))
    return two_hop(row_normalised(ui), ui.join(sums, "item"), diagonal, F.col("c"))


def paths(ui: DataFrame, values: DataFrame | None = None, name: str = "", **more) -> Graph:
    """The graph of counts w, with a value of the items of ``ui``."""
    return Graph(ui.withColumnRenamed("w", "x"), z=None if values is None else values.select("item", F.col(name).alias("z")), **more)


def cooccurrence_paths(ui: DataFrame, stats: DataFrame | None = None) -> Graph:
    """``cooccurrence`` by its paths; with ``stats`` their popularity tells novel items."""
    return paths(ui, stats, "pop")


def cosine_paths(ui: DataFrame) -> Graph:
    return paths(ui, norms(ui), "q", finish=lambda w, src, dst, start: w / np.sqrt(src * dst))


def conditional_paths(ui: DataFrame, alpha: float = 0.5) -> Graph:
    one = binary(ui)
    return paths(one, norms(one), "q", finish=lambda w, src, dst, start: w / (src * dst**alpha))


def conditional_sums(ui: DataFrame, alpha: float = 0.5) -> Graph:
    """``conditional`` summed over items of a start: what depends on src is in the path, the rest in the end."""
    one = binary(ui)
    return paths(one, norms(one), "q", inverse=True, finish=lambda w, src, dst, start: w / dst**alpha)


def transition_paths(ui: DataFrame) -> Graph:
    return paths(ui, ui.groupBy("item").agg(F.sum("w").alias("c")), "c", over=True, shares=True)


def probability_paths(ui: DataFrame) -> Graph:
    """``to_probability`` of the co-occurrence graph."""
    return paths(ui, finish=lambda w, src, dst, start: w / np.bincount(start, weights=w)[start])


def to_probability(edges: DataFrame) -> DataFrame:
    """Out-weights of each item sum to one."""
    sums = edges.groupBy("src").agg(F.sum("w").alias("s"))
    return edges.join(sums, "src").select("src", "dst", (F.col("w") / F.col("s")).alias("w"))


def damped(edges: DataFrame, stats: DataFrame, rate: float, scale: DataFrame | None = None) -> DataFrame:
    """w times exp(-rate times the prior of dst), the prior over ``scale`` (one row, s) if given."""
    cost = stats.select(F.col("item").alias("dst"), F.col("prior").alias("cost"))
    x = edges.join(cost, "dst")
    x = x.crossJoin(F.broadcast(scale)).withColumn("cost", F.col("cost") / F.col("s")) if scale is not None else x
    return x.select("src", "dst", (F.col("w") * F.exp(-rate * F.col("cost"))).alias("w"))


def biased(edges: DataFrame, stats: DataFrame, theta: float, steps: int = 30) -> DataFrame:
    """Transitions of a walk that avoids popular items: v_j W_ij / sum_k v_k W_ik.

    W is damped by prior over mean prior, v its dominant eigenvector by ``steps`` power iterations
    from ones. The result does not depend on the length of v, so no step waits for a global norm.
    """
    w = damped(edges, stats, theta, stats.agg(F.avg("prior").alias("s")))
    v = stats.select("item", F.lit(1.0).alias("v"))
    for _ in range(steps):
        v = w.join(v.select(F.col("item").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("item")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    ahead = w.join(v.select(F.col("item").alias("dst"), "v"), "dst").select("src", "dst", (F.col("w") * F.col("v")).alias("w"))
    return to_probability(ahead.where("w > 0"))


def customer_sums(packed: DataFrame, items: Broadcast, f: np.ndarray) -> np.ndarray:
    """For each of ``items`` the sum over its customers of w times the customer's sum of w f, of rows (items, ws) a customer."""
    sent = packed.sparkSession.sparkContext.broadcast(f)  # alone, as executors keep its file until they collect garbage

    def run(batches):
        names, values = items.value, sent.value
        out = np.zeros(len(names))
        for batch in batches:
            lists = batch.column("items")
            at, w = np.searchsorted(names, lists.flatten().to_numpy()), batch.column("ws").flatten().to_numpy()
            n = np.diff(lists.offsets.to_numpy())
            if len(at):
                sums = np.add.reduceat(w * values[at], np.cumsum(n) - n)  # no list is empty
                out += np.bincount(at, weights=w * np.repeat(sums, n), minlength=len(names))
        found = np.flatnonzero(out)
        for lo in range(0, len(found), 100_000):
            part = found[lo : lo + 100_000]
            yield pa.record_batch({"place": pa.array(part), "s": pa.array(out[part])})

    rows = packed.mapInArrow(run, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).toArrow()
    sent.destroy()
    out = np.zeros(len(f))
    out[rows.column("place").to_numpy()] = rows.column("s").to_numpy()
    return out


def biased_paths(ui: DataFrame, stats: DataFrame, theta: float, steps: int = 30) -> Graph | None:
    """``biased`` of the co-occurrence probabilities by paths; None where the items are too many for the driver and all tasks.

    Edges of i weigh W_ij e_j v_j over their sum, so neither the edges nor their probabilities are made for the power iterations:
    a step sums over customers and leaves out the way back to the item.
    """
    rows = stats.join(norms(ui), "item").select("item", "prior", "q").limit(ITEMS + 1).toArrow()  # ITEMS rows at most
    if len(rows) > ITEMS:
        return None
    order = np.argsort(rows.column("item").to_numpy())
    items, prior, own = (rows.column(c).to_numpy()[order] for c in ("item", "prior", "q"))
    packed = cut(ui.groupBy("customer").agg(F.sort_array(F.collect_list(F.struct("item", "w"))).alias("r")).select(F.col("r.item").alias("items"), F.col("r.w").alias("ws")))  # a customer's own
    names = ui.sparkSession.sparkContext.broadcast(items)
    out = customer_sums(packed, names, np.ones(len(items))) - own  # whole numbers
    e, v = np.exp(-theta * prior / prior.mean()) if len(prior) else prior, np.ones(len(items))
    for _ in range(steps):
        v = np.divide(customer_sums(packed, names, e * v) - own * e * v, out, out=np.zeros(len(items)), where=out > 0)
        v /= max(v.max(initial=0), 1e-300)
    return paths(ui, scale=ui.sparkSession.sparkContext.broadcast((items, e * v)), finish=lambda w, src, dst, start: w / np.bincount(start, weights=w)[start])
