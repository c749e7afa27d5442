"""N-gram Jaccard join in the metric space of shingle sets: pivots, Voronoi regions, triangle-inequality windows.

Documents that share nothing are at distance one from each other and from every pivot, so on a whole
corpus nearly all distances are one and document pivots alone part nothing (the README has figures). The
space is therefore cut into neighbourhoods first: a set is dealt by hash into more parts than a partner
within the threshold may differ in shingles, so that such a pair has parts in common, whole and not
empty. Sets that share too few parts for any partner leave, and what is left is chained by the rarest
parts it needs into neighbourhoods. That is exact: it loses no pair within the threshold.

Within every neighbourhood, from two sets on, the join is by pivots: sets taken far-first, their exact
distances to all, Voronoi regions of the nearest pivot and one for sets that share nothing with any of
them; a set is replicated into each region whose pivot is at most twice the radius farther than its
own, and regions are joined in the same way, again and again, until one component or a few sets are
left. A region that its windows do not shrink is compared along the distance to its pivot, each set with
those that the triangle inequality leaves. Neighbourhoods over HELD shingles do the same by rounds of
DataFrame jobs until they fit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, discard, looked_up, materialise, materialise_by, released, sifted, unused, whole_text
from .components import components

PIVOTS, SAMPLE, LEAF = 8, 32, 4
#: Shingles of a neighbourhood that one task may hold, and of pivots that every executor may.
HELD, SENT = 4_000_000, 4_000_000
#: Rows of a table that may be sent to every executor: a join sends several, and the driver builds and holds each.
FEW = 100_000
#: Shingles a task; sets of a bucket, and the least number of buckets.
TASK, BUCKET, BUCKETS = 4_000_000, 4096, 32
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def word_memo() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def shingle_set(text: str, width: int, memo: Memo) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; with fewer words, of all as one; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8, person=b"short").digest(), "little")], np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        x = h[k : len(h) - width + 1 + k]
        out = (out ^ x) * ODD[0]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(shingles: np.ndarray, seed: int) -> tuple[int, bytes]:
    """A 64-bit name of a set, and the full digest that shows whether two sets ever had one name."""
    full = hashlib.blake2b(shingles.tobytes(), digest_size=16, key=seed.to_bytes(4, "little")).digest()
    return int.from_bytes(full[:8], "little", signed=True), full


def most_apart(n: int, percent: int) -> int:
    """The most shingles that are in one only of a set of ``n`` and a set of ``n`` or more within the threshold."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def level_of(n: int, percent: int) -> int:
    """2 ** level parts, so many that most of them are not empty and more than ``most_apart``."""
    apart = most_apart(n, percent)
    return (max(apart + 1, -(-10 * apart // 9)) - 1).bit_length() if apart else 0


def parts_of(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(spare, names of the parts) of a set at each level it is dealt at.

    A pair within the threshold is dealt into the parts of its smaller set, so a set is dealt at every
    level that a smaller partner may have. Of parts that are not empty, each shingle of the difference
    spoils one, so a partner shares more than ``spare`` of them, whichever they are. A set that has too
    few parts is also dealt at the next level, and so is its partner if it has too few as well; if not,
    the partner's own parts are enough.
    """
    n, out, done = len(s), [], set()
    apart = most_apart(n, percent)
    if not apart:
        return []
    mixed = (s ^ (s >> np.uint64(32))) * ODD[1]
    mixed ^= mixed >> np.uint64(29)
    least = max(1, level_of(-(-percent * n // 100), percent))
    for level in range(least, level_of(n, percent) + 1):
        while level not in done:
            done.add(level)
            top = s >> np.uint64(64 - level)
            starts = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1])
            names = (np.add.reduceat(mixed, starts) ^ np.uint64(level)) * ODD[0]
            out.append((max(0, len(starts) - apart - 1), names ^ (names >> np.uint64(31))))
            if len(starts) > apart:
                break
            level += 1
    return out


def documents(texts: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n, node, digest, dealt (parts by level); a task gives a node's parts once in a while only."""
    kind = pa.list_(pa.struct([("spare", pa.int32()), ("parts", pa.list_(pa.int64()))]))

    def read(batches):
        memo, known = word_memo(), set()
        for batch in batches:
            n, nodes, digests, parts = [], [], [], []
            for x in batch.column("text"):
                s = shingle_set(x.as_py(), width, memo)
                node, full = node_of(s, seed)
                n.append(len(s))
                nodes.append(node if len(s) else None)
                digests.append(full)
                if not len(s) or node in known:
                    parts.append(None)
                    continue
                if len(known) >= 200_000:
                    known.clear()
                known.add(node)
                parts.append([{"spare": spare, "parts": names.view(np.int64)} for spare, names in parts_of(s, percent)])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": pa.array(n, pa.int64()), "node": pa.array(nodes, pa.int64()), "digest": pa.array(digests, pa.binary()), "dealt": pa.array(parts, kind)})

    return materialise(texts.mapInArrow(read, "doc_id long, text_hash long, n long, node long, digest binary, dealt array<struct<spare:int,parts:array<long>>>"), "documents")


def shared_parts(rows: DataFrame) -> DataFrame:
    """part, node, level, spare of parts in several sets, of sets that share more parts than they can spare.

    A set that shares no more has no partner. Without it others share less, so this goes on while it
    leaves out a tenth or more of what is left. Parts are shuffled once and kept or left where they meet.
    """
    member = rows.where("dealt is not null").select("node", F.posexplode("dealt").alias("level", "d")).select("node", "level", "d.spare", F.explode("d.parts").alias("part"))

    def several(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("part")

    own = Window.partitionBy("part")  # spilled where a part has many sets
    met = member.withColumns({"lo": F.min("node").over(own), "hi": F.max("node").over(own)}).where("lo < hi")
    shared = materialise(met.select("part", "node", "level", "spare").distinct(), "shared-parts")  # in the same tasks
    released(rows.sparkSession)
    before = shared.count()
    while before:
        enough = shared.groupBy("node", "level").agg(F.count("*").alias("k"), F.first("spare").alias("spare")).where("k > spare").select("node", "level")
        active = shared.join(enough, ["node", "level"], "left_semi")
        after = materialise(active.join(several(active), "part", "left_semi"), "shared-parts")
        discard(shared)
        shared, now = after, after.count()
        if 10 * now > 9 * before:
            break
        before = now
    return shared


def neighbourhoods(rows: DataFrame) -> DataFrame:
    """node, label: sets that are chained by equal parts, under their least node; others are left out.

    Of its shared parts a set needs one more than it can spare, and takes the rarest.
    """
    shared = shared_parts(rows)
    rarity = shared.groupBy("part").agg(F.count("*").alias("k"))
    counted = shared.join(rarity, "part").groupBy("node", "level").agg(F.first("spare").alias("spare"), F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))  # a set's own
    rarest = materialise(counted.select("node", F.explode(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - F.col("spare"), F.lit(0)))).alias("x")).select("node", "x.part"), "rarest")
    first = rarest.groupBy("part").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("k")).where("lo < hi")
    edges = rarest.join(first.select("part", "lo"), "part").where("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    found = components(edges.distinct())
    discard(shared, rarest)
    return found


def sets_of(texts: DataFrame, members: DataFrame, width: int, seed: int) -> DataFrame:
    """region, node, shingles of ``members`` (text_hash, node, region), read again from a text of each; rows may repeat."""
    n, texts = members.count(), texts.select("text", "text_hash")
    if n > FEW:
        texts = sifted(texts, members, "text_hash", n)[0]
    wanted = texts.join(F.broadcast(members) if n <= FEW else members, "text_hash").select("text", "node", "region")

    def read(batches):
        memo, known = word_memo(), set()
        for batch in batches:
            out, names, regions = [], [], []
            for x, node, region in zip(batch.column("text"), batch.column("node").to_pylist(), batch.column("region").to_pylist(), strict=True):
                if node in known:
                    continue
                s = shingle_set(x.as_py(), width, memo)
                if node_of(s, seed)[0] != node:  # another text of the same hash
                    continue
                if len(known) >= 200_000:
                    known.clear()
                known.add(node)
                names.append(node)
                regions.append(region)
                out.append(s.view(np.int64))
            yield pa.record_batch({"region": pa.array(regions, pa.int64()), "node": pa.array(names, pa.int64()), "shingles": pa.array(out, pa.list_(pa.int64()))})

    return wanted.mapInArrow(read, "region long, node long, shingles array<long>")


class Region:
    """The join of one region in memory: labels of its sets, and counts of what it took by level of recursion."""

    def __init__(self, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None):
        self.percent, self.radius, self.m = percent, 1 - percent / 100, len(sets)
        self.n = np.array([len(s) for s in sets], np.int64)
        names, self.column = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.n)
        self.labels = np.arange(self.m) if labels is None else np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]]
        self.mark = np.zeros(len(names), bool)
        self.took: dict[int, list[int]] = {}

    def own(self, k: int) -> np.ndarray:
        return self.column[self.ends[k] - self.n[k] : self.ends[k]]

    def common(self, k: int, others: np.ndarray) -> np.ndarray:
        """Shingles that set ``k`` shares with each of ``others``."""
        n = self.n[others]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.ends[others] - ends, n)
        self.mark[self.own(k)] = True
        out = np.add.reduceat(self.mark[self.column[at]], ends - n, dtype=np.int64)
        self.mark[self.own(k)] = False
        return out

    def distances(self, k: int, others: np.ndarray) -> np.ndarray:
        """Exact distances of ``k`` to ``others``; those within the radius get its label."""
        both = self.common(k, others)
        union = self.n[k] + self.n[others] - both
        linked = np.unique(self.labels[others[100 * both >= self.percent * union]])
        if len(linked) > 1 or (len(linked) and linked[0] != self.labels[k]):
            self.labels[np.isin(self.labels, linked)] = self.labels[k]
        return 1 - both / union

    def count(self, level: int, regions: int, distances: int) -> None:
        own = self.took.setdefault(level, [0, 0])
        own[0] += regions
        own[1] += distances

    def open(self, members: np.ndarray) -> bool:
        labels = self.labels[members]
        return len(members) > 1 and bool((labels != labels[0]).any())

    def join(self) -> np.ndarray:
        todo = [(0, np.arange(self.m))]
        while todo:
            level, members = todo.pop()
            if not self.open(members):
                continue
            self.count(level, 1, 0)
            if len(members) <= LEAF:
                self.compare(level, members, np.zeros(len(members)))
            else:
                todo += [(level + 1, x) for x in self.cut(level, members)]
        return self.labels

    def cut(self, level: int, members: np.ndarray) -> list[np.ndarray]:
        """Voronoi regions with their windows, or none if that would not part them and they were compared."""
        d, pivots, away = [], [], np.full(len(members), np.inf)
        for _ in range(min(PIVOTS, len(members))):
            p = int(np.argmax(away)) if pivots else 0
            pivots.append(p)
            d.append(self.distances(members[p], members))
            away = np.minimum(away, d[-1])
            if not self.open(members):
                break
        self.count(level, 0, len(pivots) * len(members))
        if not self.open(members):
            return []
        near = [(x <= away + 2 * self.radius + 1e-9) & (x < 1) for x in d] + [away >= 1 - self.radius - 1e-9]
        for x in near:
            x[pivots] = False  # all their distances are known
        if sum(map(np.count_nonzero, near)) > 2 * len(members) or max(map(np.count_nonzero, near)) > 0.9 * len(members):
            self.compare(level, members, d[0])
            return []
        return [members[x] for x in near]

    def compare(self, level: int, members: np.ndarray, d: np.ndarray) -> None:
        """Compare sets of different labels whose distances to one pivot differ by the radius at most.

        Sets of the most frequent label are not compared among themselves, so only the others are gone through.
        """
        order = np.argsort(d, kind="stable")
        members, d = members[order], d[order]
        names, counts = np.unique(self.labels[members], return_counts=True)
        lo, hi = np.searchsorted(d, d - self.radius - 1e-9), np.searchsorted(d, d + self.radius + 1e-9, side="right")
        for k in np.flatnonzero(self.labels[members] != names[np.argmax(counts)]):
            others = members[lo[k] : hi[k]]
            small, large = np.minimum(self.n[others], self.n[members[k]]), np.maximum(self.n[others], self.n[members[k]])
            others = others[(self.labels[others] != self.labels[members[k]]) & (100 * small >= self.percent * large)]
            if len(others):
                self.distances(members[k], others)
                self.count(level, 0, len(others))


def joined(rows: DataFrame, percent: int) -> DataFrame:
    """node, label of sets linked with others, from rows (region, node, label, shingles) sorted by region and node.

    Rows without a node count regions and distances by level of recursion. A task holds one region at a time.
    """

    def run(batches):
        took: dict[int, list[int]] = {}

        def close(nodes, labels, sets):
            if len(nodes) < 2:
                return
            region = Region(sets, percent, np.array(labels))
            found = region.join()
            for level, own in region.took.items():
                have = took.setdefault(level, [0, 0])
                have[0] += own[0]
                have[1] += own[1]
            nodes = np.array(nodes, np.int64)
            least = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(least, found, nodes)
            several = np.bincount(found, minlength=len(nodes))[found] > 1
            yield pa.record_batch({"node": pa.array(nodes[several]), "label": pa.array(least[found][several]), "level": pa.nulls(int(several.sum()), pa.int32()), "regions": pa.nulls(int(several.sum()), pa.int64()), "distances": pa.nulls(int(several.sum()), pa.int64())})

        region, nodes, labels, sets = None, [], [], []
        for batch in batches:
            values, offsets = batch.column("shingles").values.to_numpy(zero_copy_only=False).view(np.uint64), batch.column("shingles").offsets.to_numpy()
            for k, (r, node, label) in enumerate(zip(batch.column("region").to_pylist(), batch.column("node").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                if r != region:
                    yield from close(nodes, labels, sets)
                    region, nodes, labels, sets = r, [], [], []
                if nodes and nodes[-1] == node:
                    continue
                nodes.append(node)
                labels.append(label)
                sets.append(values[offsets[k] : offsets[k + 1]])
        yield from close(nodes, labels, sets)
        levels = sorted(took)
        none = pa.nulls(len(levels), pa.int64())
        yield pa.record_batch({"node": none, "label": none, "level": pa.array(levels, pa.int32()), "regions": pa.array([took[k][0] for k in levels], pa.int64()), "distances": pa.array([took[k][1] for k in levels], pa.int64())})

    return rows.select("region", "node", "label", "shingles").mapInArrow(run, "node long, label long, level int, regions long, distances long")


def dealt(rows: DataFrame, shingles: int) -> DataFrame:
    """Whole regions to tasks of about TASK shingles, in order."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-shingles // TASK))
    return rows.repartition(tasks, "region").sortWithinPartitions("region", "node")


def far_first(percent: int):
    """Of a region's sample, bounded in number, the sets that are far from each other."""

    def choose(pdf):
        region = Region([np.array(s, np.int64) for s in pdf["shingles"]], percent)
        every, taken = np.arange(len(pdf)), [0]
        away = region.distances(0, every)
        while len(taken) < min(PIVOTS, len(pdf)):
            taken.append(int(np.argmax(away)))
            away = np.minimum(away, region.distances(taken[-1], every))
        return pdf.iloc[sorted(set(taken))]

    return choose


def large_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that complete the components of regions (region, node, n) too large for one task.

    A round measures all members against a few pivots, cuts regions by their windows and gives those that
    fit to ``joined``. A region that windows do not shrink is compared by blocks: sets outside its most
    frequent label in blocks against all, each pair of blocks a task.
    """
    spark, radius, turn = cells.sparkSession, 1 - percent / 100, 0
    links = materialise(spark.createDataFrame([], "a long, b long"), "links")
    while cells.limit(1).count():
        turn += 1
        draw = [F.min(F.struct(F.xxhash64("node", F.lit(turn * SAMPLE + k)), "node"))["node"] for k in range(SAMPLE)]
        drawn = cells.groupBy("region").agg(F.array_distinct(F.array(*draw)).alias("node")).select("region", F.explode("node").alias("node"))
        pivots = drawn.join(sets, "node").select("region", "node", "shingles").groupBy("region").applyInPandas(far_first(percent), "region long, node long, shingles array<long>")
        pivots = materialise(pivots.groupBy("region").agg(F.collect_list(F.struct(F.col("node").alias("p"), "shingles")).alias("pivots")), "pivots")
        held = pivots.agg(F.sum(F.aggregate("pivots", F.lit(0), lambda s, x: s + F.size(x["shingles"])))).first()[0]
        rows = cells.join(sets, "node")
        if held <= SENT:
            rows = rows.join(F.broadcast(pivots), "region")
        else:  # a region's rows go to many tasks
            salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)).cast("int")).join(salted, ["region", "salt"])
        both = lambda x: F.size(F.array_intersect("shingles", x["shingles"]))
        near = F.transform("pivots", lambda x: F.struct(x["p"].alias("p"), both(x).alias("both"), (F.col("n") + F.size(x["shingles"])).alias("sum")))
        measured = materialise(rows.select("region", "node", "n", near.alias("near")), "measured")
        found = measured.select("node", F.explode("near").alias("x")).where("100 * x.both >= %d * (x.sum - x.both) and node <> x.p" % percent)
        after = materialise(links.unionByName(found.select(F.col("node").alias("a"), F.col("x.p").alias("b"))).distinct(), "links")
        discard(links)
        links, labels = after, components(after)

        distance = lambda x: 1 - x["both"] / (x["sum"] - x["both"])
        rest = measured.where(~F.exists("near", lambda x: x["p"] == F.col("node"))).join(pivots.select("region", F.size("pivots").alias("k")), "region")
        rest = rest.withColumn("home", F.array_min(F.transform("near", distance)))
        inside = F.transform(F.filter("near", lambda x: (distance(x) <= F.col("home") + 2 * radius + 1e-9) & (distance(x) < 1)), lambda x: F.xxhash64("region", x["p"], F.lit(turn)))
        outside = F.when(F.col("home") >= 1 - radius - 1e-9, F.array(F.xxhash64("region", F.lit("outside"), F.lit(turn)))).otherwise(F.array().cast("array<long>"))
        windows = materialise(looked_up(rest.select("region", "node", "n", F.concat(inside, outside).alias("to")), labels, "node", FEW).withColumn("label", F.coalesce("label", "node")), "windows")
        old = windows.groupBy("region").agg(F.count("*").alias("members"), F.sum(F.size("to")).alias("replicas"), F.sum("n").alias("total"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        largest = windows.select("region", F.explode("to").alias("child")).groupBy("region", "child").count().groupBy("region").agg(F.max("count").alias("child_members"))
        old = materialise(old.where("lo < hi").join(largest, "region", "left").withColumn("parted", F.expr("replicas <= 2 * members and child_members <= 0.9 * members")), "old")
        side = F.broadcast(old.select("region", "parted", "total")) if old.count() <= FEW else old.select("region", "parted", "total")
        windows = windows.join(side, "region")
        children = windows.where("parted").select(F.explode("to").alias("region"), "node", "n", "label")
        sizes = children.groupBy("region").agg(F.sum("n").alias("total"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("region", "total")
        children = materialise(children.join(sizes, "region"), "children")
        tasks = children.where(F.col("total") <= HELD).select("region", "node", "label", "n").unionByName(block_pairs(windows.where("not parted")))
        tasks = materialise(tasks, "tasks")
        total = tasks.agg(F.sum("n")).first()[0] or 0
        done = joined(dealt(tasks.join(sets, "node").select("region", "node", "label", "shingles"), total), percent).where("node is not null and node <> label")
        after = materialise(links.unionByName(done.select(F.col("node").alias("a"), F.col("label").alias("b"))).distinct(), "links")
        before, cells = (cells, windows, old, measured, pivots, links, tasks), materialise(children.where(F.col("total") > HELD).select("region", "node", "n"), "cells")
        discard(*before, children, labels)
        links = after
    return links


def block_pairs(windows: DataFrame) -> DataFrame:
    """region, node, label, n: tasks of two blocks each, of regions (region, node, n, label) that windows do not part.

    Sets of the most frequent label are linked already, so their blocks meet those of the others only.
    """
    most = windows.groupBy("region", "label").agg(F.count("*").alias("k")).groupBy("region").agg(F.max(F.struct("k", "label"))["label"].alias("most"))
    rows = windows.join(most, "region").withColumn("often", F.col("label") == F.col("most"))
    blocks = rows.groupBy("region").agg(*(F.ceil(2 * F.coalesce(F.sum(F.when(F.col("often") == often, F.col("n"))), F.lit(0)) / HELD).alias(name) for name, often in (("mine", False), ("theirs", True))))
    rows = rows.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("often"), F.col("theirs")).otherwise(F.col("mine"))))
    task = lambda i, j: F.xxhash64("region", i, j)
    mine = F.sequence(F.lit(0).cast("long"), F.col("mine") - 1)
    with_mine = F.transform(mine, lambda j: task(F.least("block", j), F.greatest("block", j)))
    with_theirs = F.when(F.col("theirs") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("theirs") - 1, F.lit(0))), lambda j: task(F.col("block"), -1 - j))).otherwise(F.array().cast("array<long>"))
    to = F.when(F.col("often"), F.transform(mine, lambda i: task(i, -1 - F.col("block")))).otherwise(F.concat(with_mine, with_theirs))
    return rows.select(F.explode(to).alias("region"), "node", "label", "n")


class Labels:
    """rows: doc_id, text_hash, n, node of every document; labels: node, label of sets in components of several; nodes: n, text_hash, least doc_id and rows of each set."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        texts, seed = whole_text(docs).withColumn("text_hash", F.xxhash64("text")), 1
        while True:
            self.rows = documents(texts, width, percent, seed)
            nodes = self.rows.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("least"), F.count("*").alias("k"), (F.min("digest") < F.max("digest")).alias("two"))
            self.nodes = materialise(nodes, "nodes")
            if self.nodes.where("two").limit(1).count() == 0:
                break
            seed += 1  # two sets had one name
            discard(self.rows, self.nodes)
        released(docs.sparkSession)
        near = neighbourhoods(self.rows)
        self.rows = self.rows.select("doc_id", "text_hash", "n", "node")
        side = F.broadcast(near) if near.count() <= FEW else near
        members = materialise(self.nodes.join(side, "node").select("node", "n", "text_hash", F.col("label").alias("region")), "members")
        sizes = members.groupBy("region").agg(F.sum("n").alias("total"))
        large = materialise(sizes.where(F.col("total") > HELD).select("region"), "large")  # one to HELD shingles, so few
        total = members.agg(F.sum("n")).first()[0] or 0
        held = members.join(F.broadcast(large), "region", "left_anti")
        sets = sets_of(texts, held.select("text_hash", "node", "region"), width, seed)
        self.found = materialise(joined(dealt(sets.withColumn("label", F.col("node")), total), percent), "labels")
        self.labels = self.found.where("node is not null").select("node", "label")
        if large.limit(1).count():
            own = materialise(members.join(F.broadcast(large), "region"), "large-members")
            n = own.count()
            sets = sets_of(texts, own.select("text_hash", "node", "region"), width, seed).select("node", "shingles")
            buckets = max(BUCKETS, -(-n // BUCKET))
            sets = materialise_by(sets.repartition(buckets, "node").groupBy("node").agg(F.first("shingles").alias("shingles")), "node", buckets, "sets")
            links = large_links(own.select("region", "node", "n"), sets, percent)
            self.labels = materialise(self.labels.unionByName(components(links)), "labels")
            discard(sets, links, own)
        discard(near, members, large)

    def levels(self) -> DataFrame:
        """level, regions, distances: what the joins in memory took, by level of recursion."""
        return self.found.where("level is not null").groupBy("level").agg(F.sum("regions").alias("regions"), F.sum("distances").alias("distances"))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; links are pairs at ``percent`` or more.

    Rows with equal sets are one node, so copies cost nothing. Parts end in an aggregate that keeps two
    nodes a part; only texts of neighbourhoods are read again. No component is brought to the driver.

    Null or empty text, or no words: an empty set, linked with nothing. Null id: the row links as any
    other and the least id of the others names the component; null if there is none. Repeated ids and
    rows: each row counts. Empty table: no rows. Other columns are ignored.
    """
    found = Labels(docs, width, percent)
    nodes = looked_up(found.nodes.select("node", "least", "k"), found.labels, "node", FEW).withColumn("own", F.coalesce("label", "node"))
    nodes = materialise(nodes.where("k > 1 or label is not null").select("node", "least", "own"), "named")
    least = materialise(nodes.groupBy("own").agg(F.min("least").alias("component")), "least")
    named = materialise(looked_up(nodes.select("node", "own"), least, "own", FEW).select("node", "component", F.lit(True).alias("shared")), "component")
    out = looked_up(found.rows, named, "node", FEW)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("shared"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``: of the least id, and of the least text hash where that id repeats in it.

    Rows are told apart by id and text, so an id that repeats with unrelated texts keeps a row of each.
    Rows with a null id or an empty set (null or empty text among them) are kept; equal rows are one
    component, of which one stays. Empty table: no rows. All columns are kept, whatever their names.
    """
    found = Labels(docs, width, percent)
    rows = looked_up(found.rows.where("doc_id is not null and node is not null"), found.labels, "node", FEW).select("doc_id", "text_hash", F.coalesce("label", "node").alias("label"))
    rows = materialise(rows, "components")
    first = rows.groupBy("label").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "text_hash")).alias("first")).where("rows > 1").select("label", "first")
    first = materialise(first, "first")
    shared = looked_up(rows, first, "label", FEW).where("first is not null")
    d, h, own, text = unused(docs, "_d", "_h", "_id", "_text")
    shared = materialise(shared.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays")), "shared-rows")
    same = lambda rows: [F.col(own) == rows[d], F.col(text) == rows[h]]
    small = lambda rows: F.broadcast(rows) if rows.count() <= FEW else rows
    named = docs.withColumns({own: F.col("doc_id").cast("long"), text: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    losers = materialise(shared.where("not stays").select(d, h).distinct(), "losers")
    n = losers.count()
    if n <= FEW:
        out = named.join(F.broadcast(losers), same(losers), "left_anti")
    else:
        may, out = sifted(named, losers.withColumnRenamed(h, text), text, n)
        out = out.unionByName(may.join(losers, same(losers), "left_anti"))
    released(docs.sparkSession)
    again = materialise(shared.where("stays").groupBy(d, h).count().where("count > 1").select(d, h), "again")
    if again.limit(1).count():
        again = small(again)
        out = out.join(again, same(again), "left_anti").unionByName(out.join(again, same(again), "left_semi").dropDuplicates([own, text]))
    return out.drop(own, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_jaccard_regions": query}
ORACLES = {
    "op6_jaccard_regions": r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS MATERIALIZED (
    SELECT k, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
sets AS (SELECT s, min(k) AS node, len(s) AS n FROM (SELECT k, list_sort(s) AS s FROM shingles) GROUP BY s),
of_row AS (SELECT x.k, t.node, t.n FROM (SELECT k, list_sort(s) AS s FROM shingles) x JOIN sets t ON x.s = t.s),
items AS (SELECT node, n, unnest(s) AS s FROM sets),
often AS (SELECT s FROM items GROUP BY s HAVING count(*) > 1),
shared AS (SELECT i.node, i.n, i.s FROM items i SEMI JOIN often o ON i.s = o.s),
pairs AS (SELECT a.node AS a, b.node AS b FROM shared a JOIN shared b ON a.s = b.s AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, other) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT r.node, min(w.doc_id) AS doc_id FROM reach r JOIN of_row o ON o.node = r.other JOIN words w ON w.k = o.k GROUP BY r.node),
own AS (SELECT o.node, min(w.doc_id) AS doc_id FROM of_row o JOIN words w ON w.k = o.k GROUP BY o.node)
SELECT w.doc_id, o.n AS n_shingles, CASE WHEN o.n = 0 THEN w.doc_id ELSE coalesce(l.doc_id, m.doc_id) END AS component_id
FROM words w JOIN of_row o ON w.k = o.k JOIN own m ON m.node = o.node LEFT JOIN least l ON l.node = o.node""",
}
