"""Token-id output: best-fit-decreasing packing into id matrices with segment lengths and positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, token_ids, vocabulary, whole_text

SCHEMA = "sequence_id long, n_tokens int, ids binary, segment_ends array<int>, positions binary, doc_ids array<long>, starts array<long>, doc_tokens array<long>"


class Capacities:
    """Open bins by free space, with a segment tree that finds the least free space of at least n."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int64).tolist()
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        self._count(free, 1)

    def _count(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """Remove and return (free, bin) of the fullest bin that still holds n, or None."""
        i = n + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.leaves
        self._count(free, -1)
        return free, self.bins[free].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Bins of piece indices by best-fit decreasing; no piece is longer than ``length``."""
    free, bins = Capacities(length), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        found = free.take(n)
        if found is None:
            bins.append([k])
            left, at = length - n, len(bins) - 1
        else:
            bins[found[1]].append(k)
            left, at = found[0] - n, found[1]
        if left:
            free.add(left, at)
    return bins


def token_matrices(docs: DataFrame, length: int = 1024, path: str | None = None, block_tokens: int = 8_000_000) -> DataFrame:
    """Rows of packed id matrices of all documents; each row is one sequence of at most ``length`` ids.

    ids and positions are little-endian binary (uint16 each) padded with zeros to ``length``;
    segment_ends are cumulative segment lengths; positions start again at zero in each segment;
    doc_ids, starts and doc_tokens say whence each segment is. A longer document is cut into full
    sequences and a rest. Packing goes by blocks of about ``block_tokens`` ids within a task: no
    shuffle, bounded memory, and one block's last bins are all that is lost to it.

    Null text: the end id only. Null or repeated ids and rows: each row is a document of its own.
    Empty table: no rows. Other columns are ignored.
    """
    path = path or vocabulary()

    def packed(block, first):
        pieces = [(d, s, x[s : s + length], len(x)) for d, x in block for s in range(0, len(x), length)]
        bins = best_fit([len(p[2]) for p in pieces], length)
        for at in range(0, len(bins), 2000):
            rows: list[list] = [[] for _ in range(8)]
            for i, own in enumerate(bins[at : at + 2000], at):
                ids, places = np.zeros(length, "<u2"), np.zeros(length, "<u2")
                ends, n = [], 0
                for k in own:
                    x = pieces[k][2]
                    ids[n : n + len(x)], places[n : n + len(x)] = x, np.arange(len(x))
                    n += len(x)
                    ends.append(n)
                values = (first + i, n, ids.tobytes(), ends, places.tobytes(), *([pieces[k][j] for k in own] for j in (0, 1, 3)))
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), longs, longs, longs)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        return first + len(bins)

    def pack(batches):
        from pyspark import TaskContext

        first, block, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            doc, texts = batch.column("doc_id"), batch.column("text")
            for k in range(len(texts)):
                block.append((doc[k].as_py(), token_ids(texts[k].as_py(), path)))
                n += len(block[-1][1])
                if n >= block_tokens:
                    first = yield from packed(block, first)
                    block, n = [], 0
        if block:
            yield from packed(block, first)

    return whole_text(docs).mapInArrow(pack, SCHEMA)


def write_matrices(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the matrices of ``docs`` as a table at ``path`` and return it."""
    token_matrices(docs, **options).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


def digest(table: DataFrame) -> DataFrame:
    """A row a segment, read back from the written table."""
    each = table.select("sequence_id", "ids", "segment_ends", F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens", "segment_ends")).alias("k", "p"))
    before = F.when(F.col("k") == 0, 0).otherwise(F.element_at("segment_ends", F.greatest(F.col("k"), F.lit(1))))
    return each.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), (F.col("p.segment_ends") - before).cast("long").alias("length"), F.crc32(F.substring("ids", before * 2 + 1, (F.col("p.segment_ends") - before) * 2)).alias("ids_crc32"), F.col("p.doc_tokens").alias("doc_tokens"), "sequence_id", before.cast("long").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32 (of little-endian uint16 ids), doc_tokens, sequence_id, offset of every segment."""
    return digest(write_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "matrices")))


QUERIES = {"op1_token_matrices": query}
ORACLES: dict[str, str] = {}
