"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW, materialise, n_words_of, unused

WEIGHTS, MOST_COPIES, GROUP = (5.0, 2.0, 1.0), 3, 256
UNIT = ("size", "doc_id", "hash", "m", "whole", "p")
KINDS = dict(zip(UNIT, ("bigint", "bigint", "bigint", "bigint", "bigint", "double"), strict=True))


def with_small(rows: DataFrame, small: DataFrame, keys: list[str], most_rows: int = 20_000) -> DataFrame:
    """Null-safe join of a table by key, sent to every executor only if it was counted to be small."""
    side = small.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(F.broadcast(side) if small.limit(most_rows + 1).count() <= most_rows else side, on).drop(*(f"_{k}" for k in keys))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, rate from a row a source with its size.

    Weights go round by code point, null last. Targets share the sum of all sizes; those that would
    pass MOST_COPIES times their source stop there, and a common level shares the rest by weight.
    """
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(rank - 1, F.lit(len(WEIGHTS))).cast("int") + 1)).withColumn("cap", MOST_COPIES * F.col("source_size").cast("double"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = weighted.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    first = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"]
    target = F.least("cap", F.coalesce(first, F.lit(0.0)) * F.col("w"))
    filled = level.withColumn("target", target)
    return filled.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def chance(x: Column, level: int, seed: int) -> Column:
    """A number in [0, 1) that depends on the unit alone."""
    return F.pmod(F.xxhash64(x["doc_id"], x["hash"], x["size"], F.lit(level), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def paired(units: Column, level: int, seed: int) -> Column:
    """Go through a bounded sorted array of units and pair the one that is still fractional with the next.

    Mass is words: what one of the pair gains, p times its size, the other loses, until one is
    integral; the direction is drawn so that each p keeps its expectation. A struct: done (units with
    p 0 or 1) and open (the one left, or null).
    """
    unit = "struct<" + ",".join(f"{k}:{v}" for k, v in KINDS.items()) + ">"
    with_p = lambda x, p: F.struct(*(x[k].alias(k) for k in UNIT[:-1]), p.cast("double").alias("p")).cast(unit)
    state = lambda done, left: F.struct(done.alias("done"), left.alias("open"))
    none = F.lit(None).cast(unit)

    def step(s: Column, x: Column) -> Column:
        a, b, size_a, size_b = s["open"]["p"], x["p"], s["open"]["size"], x["size"]
        # words that can go from x to the open one, and back, until one of the two is integral
        there, back = F.least((1 - a) * size_a, b * size_b), F.least(a * size_a, (1 - b) * size_b)
        go = chance(x, level, seed) * (there + back) < back
        p_open = F.when(go, F.when((1 - a) * size_a <= b * size_b, 1.0).otherwise(a + there / size_a)).otherwise(F.when(a * size_a <= (1 - b) * size_b, 0.0).otherwise(a - back / size_a))
        p_x = F.when(go, F.when(b * size_b <= (1 - a) * size_a, 0.0).otherwise(b - there / size_b)).otherwise(F.when((1 - b) * size_b <= a * size_a, 1.0).otherwise(b + back / size_b))
        open_, own = with_p(s["open"], p_open), with_p(x, p_x)
        integral = lambda y: (y["p"] <= 0) | (y["p"] >= 1)
        settled = F.filter(F.array(open_, own), integral)
        rest = F.get(F.filter(F.array(open_, own), lambda y: ~integral(y)), F.lit(0))
        return F.when(s["open"].isNull(), state(s["done"], x)).otherwise(state(F.concat(s["done"], settled), rest))

    return F.aggregate(units, state(F.array().cast(f"array<{unit}>"), none), step)


def reduced(units: DataFrame, keys: list[Column], level: int, seed: int) -> DataFrame:
    """One level of the tree: each group of keys keeps one fractional unit at most. Written, as two readers follow."""
    grouped = units.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*UNIT)), asc=False).alias("units"))
    names = [c for c in grouped.columns if c != "units"]
    return materialise(grouped.select(*names, paired(F.col("units"), level, seed).alias("r")).select(*names, "r.done", "r.open"), f"mix{level}")


def settled(level: DataFrame) -> DataFrame:
    return level.select("source", F.explode("done").alias("u")).select("source", "u.*")


def still_open(level: DataFrame, *keys: str) -> DataFrame:
    return level.where(F.col("open").isNotNull()).select(*keys, "open.*")


def measured(docs: DataFrame) -> DataFrame:
    """A row for each different (source, doc_id, size, hash of the text) with m, how many rows are such."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), n_words_of(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    return materialise(rows.groupBy("source", "doc_id", "size", "hash").agg(F.count("*").alias("m")), "mix")


def mixed_units(docs: DataFrame, seed: int = 11) -> DataFrame:
    """source, doc_id, size, hash, m, total: how many copies its m equal rows give the mix; source_size, target."""
    rows = measured(docs)
    targets = materialise(source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))), "targets")
    rows = with_small(rows, targets.select("source", "rate"), ["source"])
    wanted = F.col("rate") * F.col("m")
    rows = rows.withColumn("whole", F.floor(wanted)).withColumn("p", wanted - F.col("whole"))
    idle = (F.col("p") <= 0) | (F.col("size") == 0)
    buckets = materialise(rows.where(~idle).groupBy("source").agg(F.ceil(F.count("*") / GROUP).alias("buckets")), "buckets")
    most = buckets.agg(F.max("buckets")).first()[0] or 1
    active = with_small(rows.where(~idle), buckets, ["source"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "hash", F.lit(seed)), F.col("buckets")))
    level, n = reduced(active, ["source", "bucket"], 0, seed), 0
    out = rows.where(idle).select("source", *UNIT[:-1], F.lit(0.0).alias("p")).unionByName(settled(level))
    while most > 1:
        most, n = -(-most // GROUP), n + 1
        level = reduced(still_open(level, "source", "bucket"), ["source", F.floor(F.col("bucket") / GROUP).alias("bucket")], n, seed)
        out = out.unionByName(settled(level))
    last = still_open(level, "source")
    u = chance({k: F.col(k) for k in UNIT}, n + 1, seed)
    out = out.unionByName(last.withColumn("p", (u < F.col("p")).cast("double")))
    out = out.select("source", "doc_id", "size", "hash", "m", (F.col("whole") + F.col("p").cast("long")).alias("total"))
    return with_small(out, targets.drop("rate"), ["source"])


def copies_of(k: Column) -> Column:
    """Copies of the k-th of m equal rows, from 0."""
    return F.floor(F.col("total") / F.col("m")) + (k < F.pmod(F.col("total"), F.col("m"))).cast("long")


def pivotal_mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken, source, copies.

    A source's documents all have the same expected copies, target / source_size. The fractional part
    is rounded by pairing documents, largest first, with words as the mass that moves, so that each
    pair keeps its words and a source misses its target by part of one document: groups of about GROUP
    within a source, then a tree over what the groups left open. Equal rows are one unit that counts
    several times, so no group grows with the rows of one id or source.

    Null source: a source of its own, ranked last. Null text: size 0, never taken. Null ids are
    allowed. All sizes 0: targets 0, nothing taken. Empty table: no rows. Other columns are ignored.
    """
    units = mixed_units(docs, seed)
    rows = units.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies_of(F.col("k"))).alias("taken"), "source", copies_of(F.col("k")).alias("copies"))


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Null text or no words: size 0, not in the mix. Null sources and ids are matched as such; equal rows
    share their copies, and rows that differ in other columns only count as equal. Empty table: no rows.
    All columns are kept, whatever their names.
    """
    s, d, h, m, total, n, k = unused(docs, "_s", "_d", "_h", "_m", "_total", "_n", "_k")
    units = materialise(mixed_units(docs, seed), "mixed").where("total > 0").select(F.col("source").alias(s), F.col("doc_id").alias(d), F.col("hash").alias(h), F.col("m").alias(m), F.col("total").alias(total))
    own = docs.withColumns({s + "x": F.col("source").cast("string"), d + "x": F.col("doc_id").cast("long"), h + "x": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    on = [F.col(c + "x").eqNullSafe(F.col(c)) for c in (s, d, h)]
    kept = [F.col(f"`{c}`") for c in docs.columns]

    def repeated(rows: DataFrame, k: Column) -> DataFrame:
        copies = F.floor(F.col(total) / F.col(m)) + (k < F.pmod(F.col(total), F.col(m))).cast("long")
        return rows.withColumn(n, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*kept)

    once = repeated(own.join(units.where(F.col(m) == 1), on), F.lit(0))
    many = units.where(F.col(m) > 1)
    if many.limit(1).count() == 0:
        return once
    # places of equal rows: within their task first, then after those of the tasks before, so that no group is gathered
    rows = own.join(F.broadcast(many) if many.count() <= FEW else many, on).withColumn(n, F.spark_partition_id())
    rows = materialise(rows.withColumn(k, F.row_number().over(Window.partitionBy(n, s, d, h).orderBy(h)).cast("long") - 1), "repeated")
    counts = rows.groupBy(s, d, h, n).count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy(s, d, h).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)))
    before = materialise(before.select(*(F.col(c).alias(c + "y") for c in (s, d, h, n)), F.coalesce("before", F.lit(0)).alias(n + "z")), "before")
    placed = rows.join(F.broadcast(before) if before.count() <= FEW else before, [F.col(c).eqNullSafe(F.col(c + "y")) for c in (s, d, h, n)])
    return once.unionByName(repeated(placed.withColumn(k, F.col(k) + F.col(n + "z")), F.col(k)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_pivotal_mix": query}
ORACLES: dict[str, str] = {}
