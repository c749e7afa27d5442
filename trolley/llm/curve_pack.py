"""Packing along a space-filling curve: neighbours in content become neighbours in the packed sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, token_ids, vocabulary, whole_text

DIMS, BITS, FEATURES = 3, 20, 512


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims) with ``bits`` bits a coordinate (Skilling 2004)."""
    x = x.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def projection(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, DIMS)) / np.sqrt(DIMS)


def curve_keys(ids: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Hashed bag-of-ids vectors, scaled to length one, projected to few dimensions, as Hilbert keys."""
    if not ids:
        return np.zeros(0, np.int64)
    place = projection(seed)
    points = np.empty((len(ids), DIMS))
    for k, x in enumerate(ids):
        v = np.sqrt(np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(23), minlength=FEATURES))
        points[k] = v @ place / np.linalg.norm(v)
    top = (1 << BITS) - 1
    return hilbert_keys(np.clip((points + 1.5) / 3 * top, 0, top).astype(np.int64), BITS)


def tokenised(docs: DataFrame, path: str, seed: int = 7) -> DataFrame:
    """doc_id, n (ids with the end id), ids (uint16), key (on the curve) of every whole text."""

    def encode(batches):
        for batch in batches:
            texts = batch.column("text")
            ids = [token_ids(texts[i].as_py(), path) for i in range(len(texts))]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
                "key": pa.array(curve_keys(ids, seed), pa.int64()),
            })

    return whole_text(docs).mapInArrow(encode, "doc_id long, n long, ids binary, key long")


def curve_pack(docs: DataFrame, length: int = 1024, path: str | None = None, tokens_a_task: int = 16_000_000, seed: int = 7) -> DataFrame:
    """Pack all documents into sequences of ``length`` ids along a Hilbert curve.

    Returns a row a piece: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens,
    sequence_id, offset. Documents are cut where a sequence is full, so each task leaves one sequence
    that is short at most. Ids are read once from text and kept as a scratch table; ranges are cut on
    (key, hash of the id), so that any number of copies under one key spreads over tasks.

    Null text: the end id only. Null or repeated ids and rows: each row is a document of its own.
    Empty table: no rows. Other columns are ignored.
    """
    path = path or vocabulary()
    table = materialise(tokenised(docs, path, seed), "curve")
    total = table.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-total // tokens_a_task))
    salt = F.xxhash64("doc_id", "n")
    ranged = table.repartitionByRange(int(tasks), F.col("key"), salt).sortWithinPartitions("key", salt, "doc_id")

    def pack(batches):
        from pyspark import TaskContext

        base, at = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            doc, ids = batch.column("doc_id"), batch.column("ids")
            rows: list[list] = [[] for _ in range(7)]
            for k in range(len(ids)):
                x = np.frombuffer(ids[k].as_buffer(), np.uint16).astype("<u4")
                d, done = doc[k].as_py(), 0
                while done < len(x):
                    take = min(len(x) - done, length - at % length)
                    for column, v in zip(rows, (d, done, take, x[done : done + take].tobytes(), len(x), base + at // length, at % length), strict=True):
                        column.append(v)
                    done, at = done + take, at + take
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return ranged.select("doc_id", "ids").mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(curve_pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op3_curve_pack": query}
ORACLES: dict[str, str] = {}
