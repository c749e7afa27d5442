"""Pieces that the training-data operators share: scratch tables, folds, words, tokenizer ids, tree sums."""

from __future__ import annotations

import atexit
import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
END_ID = 0
#: Rows of a table that may be sent to every executor, and of a key that a shuffle may bring to one task.
FEW, HOT = 500_000, 1_000_000
#: Bits of a piece of a sieve (what bitmap_construct_agg makes), and of a sieve at most.
BITS, MOST_BITS = 32_768, 1 << 26

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where none is set and the session is local."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/trolley"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = table.__dict__.get("_scratch")
        for entry in [e for e in _written if e[1] == path]:
            _written.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_table_of(path)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise_by(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``materialise`` in buckets of ``key``: later joins on it shuffle their other side only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = _table_of(path)
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out._scratch = path
    return out


def _table_of(path: str) -> str:
    return "scratch_" + path.rsplit("-", 1)[1]


def drop_scratch() -> None:
    """Delete every scratch table of this process; results that still read one must be written first."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended
            return


atexit.register(drop_scratch)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names`` made longer until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def released(spark: SparkSession) -> None:
    """Free tables that were sent to executors, and shuffle files, of plans that nothing refers to any more: else the
    driver holds them until its heap happens to be collected."""
    spark.sparkContext._jvm.System.gc()


def sieve(keys: DataFrame, key: str, n: int) -> DataFrame:
    """bucket, bits: a bit for the hash of each of ``n`` keys, of 64 bits a key and MOST_BITS at most, in pieces of 4 KB."""
    wide = min(MOST_BITS, 1 << max(15, (64 * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(wide))
    pieces = keys.select((place / BITS).cast("long").alias("bucket"), (place % BITS).alias("bit"))
    return pieces.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).select("bucket", "bits", F.lit(wide).alias("wide"))


def sifted(rows: DataFrame, keys: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the ``n`` ``keys``, rows whose key is not): all of the first kind and few others
    are left to join, so that a wide table is neither shuffled nor are many keys sent to every executor."""
    bits = materialise(sieve(keys, key, n), "sieve")
    wide = bits.select("wide").first()
    bucket, held = unused(rows, "_bucket", "_bits")
    place = F.pmod(F.xxhash64(key), F.lit(wide.wide if wide else BITS))
    byte = F.conv(F.hex(F.substring(F.col(held), ((place % BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    marked = rows.withColumn(bucket, (place / BITS).cast("long")).join(F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(held))), bucket, "left")
    return marked.where(may).drop(bucket, held), marked.where(~may).drop(bucket, held)


def looked_up(rows: DataFrame, side: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """Left join with a table of one row a key: sent to every executor if it was counted to be small; if not, only
    its rows for keys of over HOT rows are, so that no key's rows meet in one task."""
    if side.count() <= few:
        return rows.join(F.broadcast(side), key, "left")
    hot = materialise(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(f"count > {HOT}").select(key), "hot")
    if hot.limit(1).count() == 0:
        return rows.join(side, key, "left")
    hot = F.broadcast(hot)  # a HOT-th of the rows at most
    cold = rows.join(hot, key, "left_anti").join(side, key, "left")
    return cold.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(side.join(hot, key, "left_semi")), key, "left"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def whole_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and ``more`` columns only, so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def words_of(text: Column) -> Column:
    """The words of a text as an array, empty for none."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class Memo(dict):
    """A bounded cache of a function of words."""

    def __init__(self, f, most: int = 400_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.f(word)
        return out


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of ``path`` (ranks): the ids of the JSON vocabulary, several times faster."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of the whole text, then the end id; uint16, as the vocabulary has fewer than 65,536."""
    ids = encoder(path).encode(text, allowed_special="all") if "<|endoftext|>" in text else encoder(path).encode_to_numpy(text)
    out = np.empty(len(ids) + 1, np.uint16)
    out[:-1], out[-1] = ids, END_ID
    return out


def sum_blocks(parts: DataFrame, n_parts: int, fan_in: int = 32) -> dict[int, np.ndarray]:
    """Sum float64 vectors (block int, part long, v binary) over the parts by a tree of shuffles.

    No task holds more than ``fan_in`` vectors of one block, and the driver gets one vector a block.
    """
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["v"].iloc[0]).copy()
        for v in pdf["v"].iloc[1:]:
            total += np.frombuffer(v)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1], "v": [total.tobytes()]})

    while True:
        parts = parts.select("block", (F.col("part") / fan_in).cast("long").alias("part"), "v").groupBy("block", "part").applyInPandas(add, "block int, part long, v binary")
        if n_parts <= fan_in:
            return {r.block: np.frombuffer(r.v) for r in parts.collect()}
        n_parts = -(-n_parts // fan_in)


def part_vectors(total: np.ndarray, part: int, block: int = 32_768) -> Iterator[pa.RecordBatch]:
    """A task's vector in blocks, for ``sum_blocks``."""
    flat = np.ascontiguousarray(total, np.float64).ravel()
    cut = [flat[i : i + block].tobytes() for i in range(0, len(flat), block)]
    for i, v in enumerate(cut):
        yield pa.record_batch({"block": pa.array([i], pa.int32()), "part": pa.array([part], pa.int64()), "v": pa.array([v], pa.binary())})


def joined_blocks(blocks: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The summed vector of length ``n``; zeros where no task had rows."""
    return np.concatenate([blocks[i] for i in sorted(blocks)]) if blocks else np.zeros(n)


def n_parts(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())
