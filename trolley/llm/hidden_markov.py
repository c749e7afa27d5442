"""Hidden Markov language model: Baum-Welch counts summed over partitions, scores by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, fold, joined_blocks, materialise, n_parts, part_vectors, sum_blocks, whole_text

#: States; words that are a class each; classes of all other words by their ending.
STATES, OWN, ENDINGS = 6, 8192, 8192
CLASSES = OWN + ENDINGS
#: Words whose counts go to every task; the others' counts are joined.
KNOWN = 131_072
END, FOLDS, HELD_OUT = b"\n", 7, 2
SEGMENT, ADD, PRIOR = 256, 0.5, 200.0
#: Training ends when a round adds less than this share to the log-likelihood, or after so many rounds.
TOLERANCE, ROUNDS = 1e-3, 8


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def word_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """word (binary) and c over all training texts; each task counts before it sends."""

    def count(batches):
        own: Counter = Counter()

        def sent():
            items = list(own.items())
            own.clear()
            for at in range(0, len(items), 50_000):
                words, n = zip(*items[at : at + 50_000], strict=True)
                yield pa.record_batch({"word": pa.array(words, pa.binary()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for text in batch.column("text"):
                own.update(tokens(text.as_py()))
                if len(own) > most:
                    yield from sent()
        yield from sent()

    return texts.where(~F.col("held_out")).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def ending(word: bytes) -> int:
    return OWN + zlib.crc32(word[-4:]) % ENDINGS


def class_sizes(counts: DataFrame, own: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different words of each class."""

    def add(batches):
        from pyspark import TaskContext

        total, part = np.zeros((2, CLASSES)), TaskContext.get().partitionId()
        for batch in batches:
            ids = np.array([own[w] if w in own else ending(w) for w in batch.column("word").to_pylist()], np.int64)
            total[0] += np.bincount(ids, batch.column("c").to_numpy(), CLASSES)
            total[1] += np.bincount(ids, minlength=CLASSES)
        if total.any():
            yield from part_vectors(total, part)

    parts = counts.mapInArrow(add, "block int, part long, v binary")
    return tuple(joined_blocks(sum_blocks(parts, n_parts(counts)), 2 * CLASSES).reshape(2, CLASSES))


def encoded(texts: DataFrame, known: dict[bytes, int], own: dict[bytes, int], sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row a text: its classes, what the known words' counts give, and the words whose counts must be joined.

    uid numbers the rows; sums are of log10(c + 1), log10 of a word's chance within its class (its
    numerator for the known words only), and tokens with c > 0.
    """
    below = np.log10(np.maximum(sizes[0] + ADD * (sizes[1] + 1), ADD))

    def values_of(words):
        k = np.array([own.get(w, -1) for w in words], np.int64)
        c = np.array([known.get(w, 0) for w in words], float)
        end = np.array([ending(w) for w in words], np.int64)
        inner = np.where(c > 0, np.log10(c + ADD), 0) - below[end] if len(end) else c
        return np.array([np.where(k >= 0, k, end), np.log10(c + 1), np.where(k >= 0, 0, inner), c > 0, c == 0]).T

    def encode(batches):
        from pyspark import TaskContext

        uid, new, values = TaskContext.get().partitionId() << 40, [], np.zeros((0, 5))

        def number(word):
            new.append(word)
            return len(values) + len(new) - 1

        at = Memo(number, 1 << 62)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                if len(values) > 300_000:
                    at.clear()
                    values = np.zeros((0, 5))
                texts = [tokens(x.as_py()) for x in part.column("text")]
                ids = [np.array([at[w] for w in words], np.int64) for words in texts]  # each word once, then numpy
                values = np.concatenate([values, values_of(new)]) if new else values
                new.clear()
                k, rare = values[:, 0].astype(np.uint16), values[:, 4] > 0
                base, within, seen = ([float(v[x].sum()) for x in ids] for v in values.T[1:4])
                columns = {
                    "uid": pa.array(range(uid, uid + len(ids)), pa.int64()),
                    "n_tokens": pa.array(map(len, ids), pa.int64()),
                    "classes": pa.array([k[x].tobytes() for x in ids], pa.binary()),
                    "base": pa.array(base, pa.float64()),
                    "within": pa.array(within, pa.float64()),
                    "n_seen": pa.array(map(int, seen), pa.int64()),
                    "rare": pa.array([[words[i] for i in np.flatnonzero(rare[x])] for words, x in zip(texts, ids, strict=True)], pa.list_(pa.binary())),
                }
                uid += len(ids)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), *columns.values()], names=["doc_id", "held_out", *columns])

    return materialise(texts.select("doc_id", "held_out", "text").mapInArrow(encode, "doc_id long, held_out boolean, uid long, n_tokens long, classes binary, base double, within double, n_seen long, rare array<binary>"), "encoded")


def start(unigram: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chances of states, moves and classes: all alike but for noise, and states that last."""
    noise = np.exp(0.5 * np.random.default_rng(seed).standard_normal((CLASSES, STATES)))
    emit = unigram[:, None] * noise
    move = np.full((STATES, STATES), 0.02 / max(STATES - 1, 1))
    np.fill_diagonal(move, 0.98)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(0)


def expected(obs: np.ndarray, lengths: np.ndarray, model: tuple, counts: tuple) -> float:
    """Add expected counts of segments (time, segment), longest first, to ``counts``; their log-likelihood."""
    first, move, emit = model
    steps, n = obs.shape
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # segments longer than t
    e = emit[obs]
    a, scale = np.zeros((steps, n, STATES)), np.ones((steps, n))
    for t in range(steps):
        m = alive[t]
        x = e[t, :m] * (first if t == 0 else a[t - 1, :m] @ move)
        scale[t, :m] = x.sum(1)
        a[t, :m] = x / scale[t, :m, None]
    b = np.ones((n, STATES))
    for t in range(steps - 1, 0, -1):
        m = alive[t]
        after = e[t, :m] * b[:m] / scale[t, :m, None]
        counts[1][:] += move * (a[t - 1, :m].T @ after)
        a[t, :m] *= b[:m]
        b[:m] = after @ move.T
    a[0] *= b
    counts[0][:] += a[0].sum(0)
    flat = obs.ravel()
    for k in range(STATES):
        counts[2][:, k] += np.bincount(flat, a[:, :, k].ravel(), CLASSES)
    return float(np.log(scale).sum())


def baum_welch(table: DataFrame, unigram: np.ndarray, rounds: int, seed: int, tolerance: float = TOLERANCE) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[float]]:
    """Train on all texts of ``table``, in segments of SEGMENT tokens at most.

    The log-likelihood is summed with the counts: rounds end when the last one raised it by less than ``tolerance``
    of its size, after ``rounds`` at the latest. Returns the model and the log-likelihood before each round.
    """
    model = start(unigram, seed)
    shapes = [x.shape for x in model]
    length = sum(x.size for x in model) + 1
    history: list[float] = []
    for _ in range(rounds):

        def count(batches, model=model):
            from pyspark import TaskContext

            total, part, held, n = np.zeros(length), TaskContext.get().partitionId(), [], 0
            cuts = np.split(total, np.cumsum([x.size for x in model]))  # the log-likelihood is the last number
            counts = tuple(c.reshape(s) for c, s in zip(cuts[:-1], shapes, strict=True))

            def use():
                held.sort(key=len, reverse=True)
                for at in range(0, len(held), 1024):
                    own = held[at : at + 1024]
                    obs = np.zeros((len(own[0]), len(own)), np.uint16)
                    for k, x in enumerate(own):
                        obs[: len(x), k] = x
                    total[-1] += expected(obs, np.array([len(x) for x in own]), model, counts)

            for batch in batches:
                for x in batch.column("classes"):
                    ids = np.frombuffer(x.as_buffer(), np.uint16)
                    held += [ids[i : i + SEGMENT] for i in range(0, len(ids), SEGMENT)]
                    n += len(ids)
                    if n > 1_000_000:
                        use()
                        held, n = [], 0
            if held:
                use()
                yield from part_vectors(total, part)

        blocks = sum_blocks(table.where(~F.col("held_out")).select("classes").mapInArrow(count, "block int, part long, v binary"), n_parts(table))
        total = joined_blocks(blocks, length)
        cuts = np.split(total, np.cumsum([x.size for x in model]))
        first, move, emit = (c.reshape(s) for c, s in zip(cuts[:-1], shapes, strict=True))
        history.append(float(total[-1]))
        first, move, emit = first + 1, move + 1, emit + PRIOR * unigram[:, None]
        model = first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)
        if len(history) > 1 and history[-1] - history[-2] <= tolerance * abs(history[-2]):
            break
    return model, history


def forward(ids: list[np.ndarray], model: tuple) -> np.ndarray:
    """Exact log10 likelihood of each whole class sequence."""
    first, move, emit = model
    order = np.argsort([-len(x) for x in ids], kind="stable")
    lengths = np.array([len(ids[k]) for k in order])
    flat = np.concatenate([ids[k] for k in order]) if ids else np.zeros(0, np.uint16)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    out, a = np.zeros(len(ids)), None
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    for t, m in enumerate(alive):
        x = emit[flat[at[:m] + t]] * (first if t == 0 else a[:m] @ move)
        scale = x.sum(1)
        a = x / scale[:, None]
        out[:m] += np.log10(scale)
    back = np.empty(len(ids))
    back[order] = out
    return back


def language_scores(docs: DataFrame, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    The model's events are words: the state emits a class, and the class its words by their counts.
    OWN frequent words are classes of their own; all others fall into classes by their last bytes, so
    the trained tables have a fixed size while word counts are exact for the whole vocabulary. A word
    that training lacks has the chance of its class's unseen word. Counts of KNOWN frequent words go
    to every task, the others' are joined on the word.

    Null text: empty, so the end alone. Null or repeated ids and rows: each row is scored on its own.
    No training rows: N and V are 0. Empty table: no rows. Other columns are ignored.
    """
    texts = whole_text(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    counts = materialise(word_counts(texts), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = [(bytes(r.word), r.c) for r in counts.orderBy(F.col("c").desc(), "word").limit(KNOWN).collect()]  # a fixed number
    known, own = dict(top), {w: i for i, (w, _) in enumerate(top[:OWN])}
    sizes = class_sizes(counts, own)
    table = encoded(texts, known, own, sizes)
    unigram = (sizes[0] + ADD) / (n + ADD * CLASSES)
    model, _ = baum_welch(table, unigram, rounds, seed)

    def score(batches):
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("classes")]
            yield pa.record_batch([*(batch.column(c) for c in ("uid", "doc_id", "held_out", "n_tokens", "base", "n_seen")), pa.array(forward(ids, model) + batch.column("within").to_numpy(), pa.float64())], names=["uid", "doc_id", "held_out", "n_tokens", "base", "n_seen", "score"])

    scored = table.drop("rare").mapInArrow(score, "uid long, doc_id long, held_out boolean, n_tokens long, base double, n_seen long, score double")
    words = table.select("uid", F.explode("rare").alias("word"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = words.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.log10(c + 1.0)).alias("rare_base"), F.sum(F.log10(c + ADD)).alias("rare_within"), F.sum((c > 0).cast("long")).alias("rare_seen"))
    both = scored.join(rare, "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", plus("n_seen", "rare_seen").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (plus("base", "rare_base") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), plus("score", "rare_within").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_hidden_markov": query}
ORACLES: dict[str, str] = {}
