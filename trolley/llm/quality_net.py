"""Quality classifier: random-indexing word vectors, pooled per document, and a small numpy network."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, Memo, fold, joined_blocks, materialise, n_parts, part_vectors, sum_blocks, unused, whole_text

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 64, 2, 2
REPEATED = BUCKETS - 1
#: Letters, digits and marks are tokens apart, each with its case, so that odd marks and capitals are words too.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
FOLDS, HIDDEN, CUT = 5, 32, 0.3


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary index vectors: NONZERO places and signs of each bucket."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (NONZERO, BUCKETS)), rng.choice([-1.0, 1.0], (NONZERO, BUCKETS))


def bucket_ids(memo: Memo, text: str) -> np.ndarray:
    """Buckets of a text's words; a word that repeats the one before it counts as the word REPEATED."""
    ids = np.array([memo[w] for w in TOKEN.findall(text)], np.int64)
    ids[1:][ids[1:] == ids[:-1]] = REPEATED
    return ids


def bucket_memo() -> Memo:
    return Memo(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % REPEATED)


def contexts(total: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to each word the index vectors of its neighbours; -1 parts documents. The last column counts words."""
    flat = total.ravel()
    for gap in range(1, WINDOW + 1):
        a, b = ids[:-gap], ids[gap:]
        ok = (a >= 0) & (b >= 0)
        if gap > 1:
            for k in range(1, gap):
                ok &= ids[k : len(ids) - gap + k] >= 0
        a, b = a[ok], b[ok]
        for one, other in ((a, b), (b, a)):
            for place, sign in zip(places, signs, strict=True):
                flat += np.bincount(one * (DIM + 1) + place[other], weights=sign[other], minlength=len(flat))
    flat += np.bincount(ids[ids >= 0] * (DIM + 1) + DIM, minlength=len(flat))


def word_vectors(docs: DataFrame, seed: int) -> np.ndarray:
    """Unit vectors of all buckets, from the neighbours of every word of every document.

    Tasks add into one matrix of fixed size each, and a tree of shuffles adds those.
    """
    texts = whole_text(docs)

    def count(batches):
        from pyspark import TaskContext

        places, signs = index_vectors(seed)
        total, memo, part, held, n = np.zeros((BUCKETS, DIM + 1)), bucket_memo(), TaskContext.get().partitionId(), [], 0
        apart = np.full(1, -1)
        for batch in batches:
            for text in batch.column("text"):
                held += [bucket_ids(memo, text.as_py()), apart]
                n += len(held[-2]) + 1
                if n > 1_000_000:
                    contexts(total, np.concatenate(held), places, signs)
                    held, n = [], 0
        if held:
            contexts(total, np.concatenate(held), places, signs)
            yield from part_vectors(total, part)

    blocks = sum_blocks(texts.select("text").mapInArrow(count, "block int, part long, v binary"), n_parts(texts))
    total = joined_blocks(blocks, BUCKETS * (DIM + 1)).reshape(BUCKETS, DIM + 1)
    seen = total[:, DIM:]
    mean = total[:, :DIM] / np.maximum(seen, 1)
    mean -= total[:, :DIM].sum(0) / max(seen.sum(), 1)
    mean[seen[:, 0] == 0] = 0
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, text_hash and x: the mean word vector of each whole text (binary float32; zeros without words)."""

    def pool(batches):
        memo = bucket_memo()
        for batch in batches:
            out, texts = np.zeros((batch.num_rows, DIM), np.float32), batch.column("text")
            for k in range(batch.num_rows):
                ids = bucket_ids(memo, texts[k].as_py())
                for at in range(0, len(ids), 65_536):
                    out[k] += vectors[ids[at : at + 65_536]].sum(0)
                out[k] /= max(len(ids), 1)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "x": pa.array([v.tobytes() for v in out], pa.binary())})

    texts = whole_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return materialise(texts.mapInArrow(pool, "doc_id long, text_hash long, x binary"), "pooled")


class Network:
    """Two layers, fitted by Adam on log loss; probabilities are calibrated by one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 40):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        held = np.arange(len(x)) % 5 == 4  # for the temperature
        a, b = (x[~held], x[held]), (y[~held], y[held])
        self.p = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, 1)) * np.sqrt(2 / HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(a[0]))
            for at in range(0, len(order), 128):
                own = order[at : at + 128]
                xb, t = a[0][own], t + 1
                h = np.maximum(xb @ self.p[0] + self.p[1], 0)
                d = ((1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30)))).ravel() - b[0][own])[:, None] / len(own)
                dh = (d @ self.p[2].T) * (h > 0)
                for k, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    g = g + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        z, truth = self._logit(a[1]), b[1]
        loss = lambda temperature: np.mean(np.logaddexp(0, z / temperature) - truth * z / temperature)
        self.temperature = min(np.geomspace(0.25, 8, 60), key=loss) if len(z) else 1.0

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]).ravel()

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def training_rows(features: DataFrame, labels: DataFrame, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled ids outside the held-out fold, chosen by a hash of the id."""
    known = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id"), FOLDS) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    rows = features.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").collect()
    return np.array([np.frombuffer(r.x, np.float32) for r in rows], float).reshape(-1, DIM), np.array([r.y for r in rows], float)


def quality_scores(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, seed: int = 5) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted of every row of ``docs``.

    Word vectors come from all documents; the network learns from ``most_labels`` labelled ids at
    most, a stated bound, none of them held out. Only the text is an input of the score.

    Null text: as empty, whose vector is zero. Null ids are scored but teach nothing; an id with many
    rows or labels teaches once. No labels, or one class: every score is the share of ones, or 1
    without labels. Empty table: no rows. Other columns are ignored.
    """
    vectors = word_vectors(docs, seed)
    features = pooled(docs, vectors)
    x, y = training_rows(features, labels, most_labels, seed)
    net = Network(x, y, seed) if len(set(y)) > 1 else None
    same = float(y.mean()) if len(y) else 1.0

    def apply(batches):
        for batch in batches:
            v = np.array([np.frombuffer(b.as_buffer(), np.float32) for b in batch.column("x")], float).reshape(-1, DIM)
            p = net.score(v) if net else np.full(len(v), same)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "score": pa.array(p, pa.float64())})

    scored = features.mapInArrow(apply, "doc_id long, text_hash long, score double")
    return scored.select("doc_id", "text_hash", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject.

    Null text is judged as empty text is; rows are told apart by id and text, null ids among them, and
    equal rows share a verdict. Empty table: no rows. All columns are kept, whatever their names.
    """
    d, h = unused(docs, "_d", "_h")
    verdicts = materialise(quality_scores(docs, labels, **options), "verdicts")
    out = materialise(verdicts.where("predicted = 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "rejected")
    rejects = F.broadcast(out) if out.count() <= FEW else out
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(rejects, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (text == F.col(h)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_hash")


QUERIES = {"op9_quality_net": query}
ORACLES: dict[str, str] = {}
