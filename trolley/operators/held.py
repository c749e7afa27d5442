"""Walks and paths from baskets where the user-item table fits a task: steps go item - customer - item and no edge is made.

An edge from i to j weighs u(i) v(j) times the sum over customers of w(i) w(j) / t; a step over all edges of an item is two
sums over the table. Items that no chain of customers connects to a basket are left out of its steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, best_of, gathered, ranges

#: Rows of a table that a task may hold; baskets of a task and of a step; customers whose sums stay in the cache;
#: cells of a state an entry, from which on only its paths are followed.
HELD, BASKETS, WIDE, ROWS, SPARSE = 8_000_000, 1_500, 32, 1_024, 1_000


class Sums:
    """Y = A Z for a sparse A, rows by falling number of entries: the k-th entries of all rows are added at once."""

    def __init__(self, row: np.ndarray, column: np.ndarray, w: np.ndarray, rows: int):
        if len(w) and w.max() <= 4 and (w == np.floor(w)).all():  # counts: a second of an item is an entry of its own
            row, column, w = np.repeat(row, w.astype(int)), np.repeat(column, w.astype(int)), np.ones(int(w.sum()))
        n = np.bincount(row, minlength=rows)
        self.order = np.argsort(-n, kind="stable")
        self.same = bool((self.order == np.arange(rows)).all())
        by = np.argsort(row, kind="stable")
        column, w, first = column[by], w[by], np.cumsum(n) - n
        n, first = n[self.order], first[self.order]
        self.rows, self.parts, plain = rows, [], bool((w == 1).all())
        for a in range(0, rows, ROWS):
            b, layers = min(a + ROWS, rows), []
            for k in range(int(n[a]) if a < rows else 0):
                at = first[a : a + int(np.searchsorted(-n[a:b], -k, side="left"))] + k
                layers.append((column[at], None if plain or (w[at] == 1).all() else w[at][:, None]))
            self.parts.append((a, b, layers))

    def __call__(self, z: np.ndarray) -> np.ndarray:
        y, one = np.zeros((self.rows, z.shape[1])), np.empty((ROWS, z.shape[1]))
        for a, b, layers in self.parts:
            part = y[a:b]
            for at, w in layers:
                x = np.take(z, at, axis=0, out=one[: len(at)], mode="clip")
                part[: len(at)] += x if w is None else x * w
        if self.same:
            return y
        out = np.empty_like(y)
        out[self.order] = y
        return out


class Held:
    """Counts of the items of one component: sums, priors and steps."""

    def __init__(self, customer: np.ndarray, item: np.ndarray, w: np.ndarray, total: float, priors: np.ndarray):
        _, customer, n = np.unique(customer, return_inverse=True, return_counts=True)
        place = np.empty(len(n), np.int64)
        place[np.argsort(-n, kind="stable")] = np.arange(len(n))
        order = np.argsort(place[customer], kind="stable")
        customer, item, w = place[customer][order], item[order], w[order]
        self.customer, self.item, self.w = customer, item, w
        self.c, self.m = int(customer.max()) + 1, int(item.max()) + 1
        self.n = np.bincount(customer)
        self.first = np.cumsum(self.n) - self.n
        self.by_item = np.argsort(item, kind="stable")
        self.item_n = np.bincount(item, minlength=self.m)
        self.item_first = np.cumsum(self.item_n) - self.item_n
        self.pop = np.bincount(item, weights=w, minlength=self.m)
        self.prior, self.mean, self.most = self.pop / total, priors.mean(), priors.max()
        self.several = np.bincount(customer, minlength=self.c) > 1
        self.up, self.down = Sums(customer, item, w, self.c), Sums(item, customer, w, self.m)
        self.t = np.ones(self.c)
        self.u, self.v = np.ones(self.m), np.ones(self.m)
        self.seal()

    def seal(self) -> None:
        self.own = np.bincount(self.item, weights=self.w * self.w / self.t[self.customer], minlength=self.m)

    def transition(self) -> None:
        self.t = np.bincount(self.customer, weights=self.w, minlength=self.c)
        self.v = 1 / self.pop
        self.seal()

    def out(self, v: np.ndarray) -> np.ndarray:
        """The sum over the other items j of the paths from an item times v(j): exactly zero where there are none."""
        each = self.w * v[self.item]
        sums = np.bincount(self.customer, weights=each, minlength=self.c) / self.t
        return np.bincount(self.item, weights=np.where(self.several[self.customer], self.w * (sums[self.customer] - each / self.t[self.customer]), 0), minlength=self.m)

    def probability(self) -> None:
        out = self.out(self.v)
        self.u = np.divide(1, out, out=np.zeros(self.m), where=out > 0)

    def damped(self, rate: float) -> None:
        self.v = self.v * np.exp(-rate * self.prior)

    def biased(self, theta: float, steps: int) -> None:
        """As ``kernels.biased``, of the probabilities that the scalings stand for."""
        e, v = self.v * np.exp(-theta * self.prior / self.mean), np.ones(self.m)
        for _ in range(steps):
            v = self.u * self.out(e * v)
            v /= v.max() if v.max() > 0 else 1
        self.v = e * v
        self.probability()

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.step(x, self.u, self.v)

    def back(self, x: np.ndarray) -> np.ndarray:
        return self.step(x, self.v, self.u)

    def step(self, x: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        z = x * u[:, None]
        if np.count_nonzero(z) * SPARSE < z.size:
            out = self.few(z)
        else:
            y = self.up(z)
            y /= self.t[:, None]
            out = self.down(y)
        z *= self.own[:, None]
        out -= z
        out *= v[:, None]
        return out

    def few(self, z: np.ndarray) -> np.ndarray:
        """The two sums of ``step`` for few entries, over their paths alone."""
        at, column = np.nonzero(z)
        hops, n = self.by_item[ranges(self.item_first[at], self.item_n[at])], self.item_n[at]
        customer = self.customer[hops]
        each, column = np.repeat(z[at, column], n) * self.w[hops] / self.t[customer], np.repeat(column, n)
        n, paths = self.n[customer], ranges(self.first[customer], self.n[customer])
        return np.bincount(self.item[paths] * z.shape[1] + np.repeat(column, n), weights=np.repeat(each, n) * self.w[paths], minlength=z.size).astype(float).reshape(z.shape)  # whole numbers if there are no paths


def walk(alpha: float, steps: int, back: bool = False) -> Callable:
    """s <- alpha s P + (1 - alpha) start, ``steps`` times from nothing."""

    def score(h: Held, start: np.ndarray) -> np.ndarray:
        home = (1 - alpha) * start
        s = home
        for _ in range(steps - 1):
            s = alpha * (h.back(s) if back else h.forward(s)) + home
        return s

    return score


def between(steps: int) -> Callable:
    """As ``walks.path_betweenness``."""

    def score(h: Held, start: np.ndarray) -> np.ndarray:
        free = start == 0
        term = first = forward = h.forward(start)
        back = reach = start
        for _ in range(steps - 1):
            term = h.forward(term * free)
            forward = forward + term
            back = h.back(back) * free
            reach = reach + back
        z = (first * reach).sum(0)
        return np.where(z > 0, forward * reach / np.where(z > 0, z, 1), 0)

    return score


def components(customer: np.ndarray, item: np.ndarray, c: int, m: int) -> np.ndarray:
    """The least item that is connected with each item, over customers and baskets."""
    label = np.arange(m)
    while True:
        least = np.full(c, m)
        np.minimum.at(least, customer, label[item])
        after = label.copy()
        np.minimum.at(after, item, least[customer])
        after = np.minimum(after, after[after])
        if (after == label).all():
            return label
        label = after


def fits(ui: DataFrame) -> bool:
    return ui.limit(HELD + 1).count() <= HELD


def recommend(items: DataFrame, ui: DataFrame, prepare: Callable, score: Callable, n: int) -> DataFrame:
    """basket, item, score: those that can be among the n best by ``score`` on the graph that ``prepare`` makes of the counts.

    Every task holds all of ``ui``, which must fit (``fits``), and has baskets that are near in number.
    """
    baskets = items.select("basket").distinct()
    spark = items.sparkSession
    low, high, count = baskets.agg(F.min("basket"), F.max("basket"), F.count("*")).first()
    if not count:
        return items.select("basket", "item", F.lit(0.0).alias("score")).limit(0)
    tasks = max(-(-count // BASKETS), min(2 * spark.sparkContext.defaultParallelism, -(-count // WIDE)))
    width = -(-(high - low + 1) // tasks)
    none = F.array().cast("array<double>")
    block = F.least(F.floor((F.col("id") - F.lit(low)) / F.lit(width)), F.lit(tasks - 1)).cast("int").alias("block")
    own = items.groupBy(F.col("basket").alias("id")).agg(F.sort_array(F.collect_set("item")).alias("items"))  # a basket's own
    own = own.select(block, F.lit(False).alias("listed"), "id", F.lit(0).cast("long").alias("sub"), "items", F.transform("items", lambda x: F.lit(1.0)).alias("x"), none.alias("y"), none.alias("z"))
    listed = ui.groupBy("customer").agg(F.sort_array(F.collect_list(F.struct("item", "w"))).alias("r"))  # a customer's own
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("block")
    lists = listed.select(every, F.lit(True).alias("listed"), F.col("customer").alias("id"), F.lit(0).cast("long").alias("sub"), F.col("r.item").alias("items"), F.col("r.w").alias("x"), none.alias("y"), none.alias("z"))

    def work(batches):
        for own, lists in gathered(batches):
            lists[5] = lists[6] = None
            b = Block(own, lists, False)
            customer = np.repeat(np.arange(len(b.n)), b.n)
            label = components(np.concatenate((customer, len(b.n) + b.owner)), np.concatenate((b.item, b.at)), len(b.n) + len(b.ids), len(b.names))  # a basket keeps its items together
            pop = np.bincount(b.item, weights=b.x, minlength=len(b.names))
            total = pop.sum()
            of_entry, of_place = label[b.item], label[b.at]
            for part in np.unique(of_place):
                inside = np.flatnonzero(label == part)
                here = of_entry == part
                h = Held(customer[here], np.searchsorted(inside, b.item[here]), b.x[here], total, pop / total)
                prepare(h)
                mine = np.flatnonzero(of_place == part)
                owners, who = np.unique(b.owner[mine], return_inverse=True)
                at = np.searchsorted(inside, b.at[mine])
                for lo in range(0, len(owners), WIDE):
                    these = (who >= lo) & (who < lo + WIDE)
                    start = np.zeros((h.m, min(WIDE, len(owners) - lo)))
                    start[at[these], who[these] - lo] = 1
                    s = score(h, start)
                    s[start > 0] = 0
                    s = np.ascontiguousarray(s.T)
                    for k in range(len(s)):
                        found = np.flatnonzero(s[k] > 0)
                        found = found[best_of(found, s[k][found], n)] if n >= 0 else found
                        yield pa.record_batch({"basket": pa.array(np.full(len(found), b.ids[owners[lo + k]])), "item": pa.array(b.names[inside[found]]), "score": pa.array(s[k][found])})

    return own.unionByName(lists).repartitionById(tasks, F.col("block")).sortWithinPartitions("block").mapInArrow(work, "basket long, item long, score double")
