"""Approximate nearest neighbours by an inverted multi-index over two halves of a vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Vectors that codebooks are fitted on at most, centroids of a half at most, rounds of fitting, vectors that one task
#: compares at most, vectors whose true neighbours say how far to walk, results that meet in one task,
#: queries that a task gets at most, and first centroids that a walk opens first.
SAMPLE, MOST_CENTROIDS, ROUNDS, BLOCK, PROBES, FAN_IN, ASKED, FIRST_WAVE = 20_000, 2048, 6, 8192, 128, 64, 50_000, 16


def clean(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and embedding (array of double) of rows that take part: ``dim`` finite components, not all zero."""
    x = F.col("embedding").cast("array<double>")
    ok = (F.size("embedding") == dim) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin((c**2).sum(1)[None, :] - 2 * x[at : at + 4096] @ c.T, axis=1)
    return out


def centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means from different rows of ``x``, in the order of their first component so that neighbours are close."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, c)
        order = np.argsort(own, kind="stable")
        names, starts = np.unique(own[order], return_index=True)
        c[names] = np.add.reduceat(x[order], starts) / np.diff([*starts, len(x)])[:, None]
    mid = c - c.mean(0)
    return c[np.argsort(mid @ np.linalg.svd(mid, full_matrices=False)[2][0], kind="stable")] if c.shape[1] else c[:1]


class Cells:
    """How many vectors each pair of centroids holds; empty pairs are not kept."""

    def __init__(self, cell: np.ndarray, count: np.ndarray, wide: int):
        order = np.argsort(cell, kind="stable")
        self.first, self.second, self.count = cell[order] // wide, cell[order] % wide, count[order]
        self.total = int(count.sum())
        self.rows, starts = np.unique(self.first, return_index=True)
        self.ends = np.zeros((int(self.rows.max(initial=-1)) + 1, 2), np.int64)
        self.ends[self.rows] = np.column_stack([starts, [*starts[1:].tolist(), len(cell)]]) if len(starts) else 0

    def pairs(self, rows: np.ndarray) -> np.ndarray:
        """Places of the pairs of some first centroids."""
        lo, n = self.ends[rows, 0], np.diff(self.ends[rows])[:, 0]
        return np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)

    def walk(self, a: np.ndarray, b: np.ndarray, enough: float) -> float:
        """The least sum a[i] + b[j] among the best pairs that together hold ``enough`` vectors.

        The multi-sequence walk in waves: first centroids open from the best on, twice as many in each wave, and
        pairs at or above the best sum that one still closed could have are final, in the order of their sums.
        """
        rows = self.rows[np.argsort(-a[self.rows], kind="stable")]
        top, opened, wave = float(b[self.second].max()), 0, FIRST_WAVE
        sums, counts, held = np.zeros(0), np.zeros(0, np.int64), 0
        while held < enough and opened < len(rows):
            at = self.pairs(rows[opened : opened + wave])
            sums, counts = np.concatenate([sums, a[self.first[at]] + b[self.second[at]]]), np.concatenate([counts, self.count[at]])
            opened, wave = opened + wave, 2 * wave
            final = sums >= (a[rows[opened]] + top if opened < len(rows) else -np.inf)
            held = int(counts[final].sum())
        if held < enough or not len(sums):
            return -np.inf
        sums, counts = sums[final], counts[final]
        best = np.argpartition(-sums, int(enough))[: int(enough) + 1] if enough < len(sums) else np.arange(len(sums))  # a pair holds one at least
        sums, counts = sums[best], counts[best]
        order = np.argsort(-sums, kind="stable")
        return float(sums[order[np.searchsorted(np.cumsum(counts[order]), enough)]])


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; equal rows have equal ones wherever they stand."""
    return (v * q).sum(1)


def walk_length(index: DataFrame, cells: Cells, books: tuple, dim: int, k: int, recall: float, seed: int) -> float:
    """Vectors a walk must hold so that a share ``recall`` of the true neighbours of PROBES vectors is among them.

    Their neighbours come from one pass over all vectors; PROBES times k rows a task and the driver.
    """
    half, probes = dim // 2, index.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(PROBES).select("vec_id", "embedding").collect()
    ids, q = np.array([r.vec_id for r in probes]), np.array([r.embedding for r in probes])

    def search(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for pdf in batches:
            v, own, cell = np.array(pdf["embedding"].tolist()).reshape(-1, dim), pdf["vec_id"].to_numpy(), pdf["cell"].to_numpy()
            for i, s in enumerate(q @ v.T):
                s = np.where(own == ids[i], -np.inf, s)
                names, scores, at = (np.concatenate(x) for x in zip(held[i], (own, s, cell), strict=True))
                best = best_of(scores, names, k)
                held[i] = names[best], scores[best], at[best]
        yield pd.DataFrame([(i, int(n), float(s), int(c)) for i, own in enumerate(held) for n, s, c in zip(*own, strict=True)], columns=["probe", "vec_id", "score", "cell"])

    found = index.select("vec_id", "embedding", "cell").mapInPandas(search, "probe int, vec_id long, score double, cell long")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "cell"))), 1, k)
    wide, needs = len(books[1]), []
    salted = found.groupBy("probe", F.pmod(F.xxhash64("vec_id"), F.lit(FAN_IN)).alias("salt")).agg(best.alias("b"))
    rows = salted.select("probe", F.explode("b").alias("b")).select("probe", (-F.col("b.s")).alias("score"), "b.vec_id", "b.cell").groupBy("probe").agg(best.alias("b"))
    for r in rows.collect():
        a, b = q[r.probe, :half] @ books[0].T, q[r.probe, half:] @ books[1].T
        sums = a[cells.first] + b[cells.second]
        order = np.argsort(-sums, kind="stable")
        held = np.cumsum(cells.count[order])
        needs += [held[np.searchsorted(-sums[order], -(a[x.cell // wide] + b[x.cell % wide]), side="right") - 1] for x in r.b if x.s < np.inf]
    return float(np.quantile(needs, recall)) if needs else float(cells.total)


def merged(found: DataFrame, k: int, blocks: int) -> DataFrame:
    """The best k rows of each query out of those of its blocks, FAN_IN blocks at a time."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    while True:
        blocks = -(-blocks // FAN_IN)
        found = found.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int")).groupBy("query_id", "query", "block").agg(best.alias("best"))
        if blocks <= 1:
            return found
        found = found.select("query_id", "query", "block", F.explode("best").alias("b")).select("query_id", "query", "block", F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, dim: int | None = None, seed: int = 13) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (query_id, embedding) the k of ``vectors`` with the largest inner products found.

    Codebooks of both halves, 8 centroids to the square root of the number of vectors (MOST_CENTROIDS at
    most, so that counts of their pairs fit every executor), are fitted on SAMPLE vectors at most, drawn
    by a hash of the id; all vectors are indexed under their pair. Each query walks the pairs from the
    largest sum of inner products until they hold enough vectors, a number that is measured on PROBES
    vectors to give ``recall`` (1: all vectors); only vectors of visited pairs are ranked, by exact double products. Vectors
    lie in blocks of about BLOCK by first centroid, and a query goes to blocks it visits.

    Vectors that are null, zero, of another size than ``dim`` (the most frequent one), or hold null or
    non-finite components take no part, nor do null ids. A row with the query's own id is no candidate.
    Repeated rows are candidates each; a query's repeated row is asked once, and other vectors under its id
    are queries of their own. Fewer candidates than k: all. Empty tables: no rows. Other columns are ignored.
    """
    if dim is None:
        row = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = row.d if row else 0
    spark, half = vectors.sparkSession, dim // 2
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim < 1:
        return empty
    table = clean(vectors, dim)
    sample = table.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("embedding").collect()
    if not sample:
        return empty
    x = np.array([r.embedding for r in sample])
    size = min(MOST_CENTROIDS, int(8 * np.sqrt(table.count())) + 1)
    books = centroids(x[:, :half], size, seed), centroids(x[:, half:], size, seed + 1)
    wide = len(books[1])

    def assign(batches):
        for pdf in batches:
            v = np.array(pdf["embedding"].tolist()).reshape(-1, dim)
            pdf["cell"] = nearest(v[:, :half], books[0]) * wide + nearest(v[:, half:], books[1])
            yield pdf

    index = materialise(table.mapInPandas(assign, "vec_id long, embedding array<double>, cell long"), "index")
    sizes = index.groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # MOST_CENTROIDS squared at most
    cells = Cells(sizes["cell"].to_numpy(), sizes["n"].to_numpy(), wide)
    enough = walk_length(index, cells, books, dim, k, recall, seed) if recall < 1 else cells.total
    of_row = np.bincount(cells.first, cells.count, len(books[0]))
    group = (np.maximum(np.cumsum(of_row) - of_row, 0) // BLOCK).astype(np.int64)  # runs of first centroids
    names, group = np.unique(group, return_inverse=True)
    blocks = np.maximum(1, -(-np.bincount(group, of_row).astype(np.int64) // (2 * BLOCK)))  # a crowded run is cut by hash
    base = np.cumsum(blocks) - blocks
    n_blocks = int(blocks.sum())
    sent = spark.sparkContext.broadcast(cells)

    def visit(batches):
        cells, known = sent.value, {}
        for pdf in batches:
            out = []
            for query_id, query, e in zip(pdf["query_id"], pdf["query"], pdf["embedding"], strict=True):
                if query not in known:  # copies walk once
                    q = np.asarray(e)
                    a, b = q[:half] @ books[0].T, q[half:] @ books[1].T
                    least = cells.walk(a, b, enough) - 1e-9
                    on = np.unique(group[cells.first[a[cells.first] + b[cells.second] >= least]])
                    if len(known) > 10_000:
                        known.clear()
                    known[query] = least, [int(base[g] + j) for g in on for j in range(blocks[g])]
                least, to = known[query]
                out += [(query_id, query, e, least, j) for j in to]
            yield pd.DataFrame(out, columns=["query_id", "query", "embedding", "least", "block"])

    asked = clean(queries.withColumnRenamed("query_id", "vec_id") if "vec_id" not in queries.columns else queries.select(F.col("query_id").alias("vec_id"), "embedding"), dim).withColumnRenamed("vec_id", "query_id").withColumn("query", F.xxhash64("embedding"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.repartition(tasks, "query_id", "query").dropDuplicates(["query_id", "query"])  # few bytes a query, but a long walk: the number keeps them apart
    chunks = max(1, -(-queries.count() // ASKED))
    visits = asked.mapInPandas(visit, "query_id long, query long, embedding array<double>, least double, block int").withColumn("chunk", F.pmod(F.xxhash64("query_id", "query", F.lit(1)), F.lit(chunks)))

    def place(batches):
        for pdf in batches:
            g = group[pdf["cell"].to_numpy() // wide]
            pdf["block"] = (base[g] + pdf.pop("salt").to_numpy() % blocks[g]).astype(np.int32)
            yield pdf

    placed = index.withColumn("salt", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 31))).mapInPandas(place, "vec_id long, embedding array<double>, cell long, block int")

    if chunks > 1:
        placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    else:
        placed = placed.withColumn("chunk", F.lit(0).cast("long"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best k of one block for each query that visits some of its cells."""
        out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
        if len(left) and len(right):
            ids, v, cell = right["vec_id"].to_numpy(), np.array(right["embedding"].tolist()), right["cell"].to_numpy()
            for query_id, query, e, least in zip(left["query_id"], left["query"], left["embedding"], left["least"], strict=True):
                q = np.asarray(e)
                sums = (q[:half] @ books[0].T)[cell // wide] + (q[half:] @ books[1].T)[cell % wide]
                on = np.flatnonzero((sums >= least) & (ids != query_id))
                s = products(v[on], q)
                best = best_of(s, ids[on], k)
                n = len(best)
                out.append((np.full(n, query_id), np.full(n, query), np.full(n, left["block"].iloc[0]), ids[on][best], s[best]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "query", "block", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    found = visits.groupBy("block", "chunk").cogroup(placed.groupBy("block", "chunk")).applyInPandas(rank, "query_id long, query long, block int, vec_id long, score double")
    ranked = merged(found, k, n_blocks).select("query_id", F.posexplode("best").alias("r", "b"))
    return ranked.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding"))


QUERIES = {"op8_multi_index": query}
ORACLES: dict[str, str] = {}
