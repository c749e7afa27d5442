"""Sharding by size-tiered compaction under a versioned manifest. DataFrame functions only."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import FEW, scratch_path, unused

TARGET, FACTOR, ARRIVALS = 128 << 20, 4, 4
MANIFEST = "file string, tier int, bytes long, rows long"


class Conflict(Exception):
    """Another writer committed the version first."""


class ShardStore:
    """Immutable shards under ``path``, and manifests that say which of them are live.

    data/<attempt>/ holds the files that one write made, each a run; manifests/<attempt>/ lists live runs;
    versions/N names the manifest and schema of version N. That one file is made by an atomic link or
    rename that fails if it exists, so of two writers of one version one gets a Conflict, and readers
    see the version before or the one after. What a crash leaves behind has no version and is never read;
    no name is used twice, so it stops no later writer, and ``sweep`` deletes it. A store is opened at
    its last version. The driver holds a row of metadata a run.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, factor: int = FACTOR):
        self.spark, self.path, self.target, self.factor = spark, path.rstrip("/"), target, factor
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.version = -1
        self.refresh()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._path(folder))] if self.fs.exists(self._path(folder)) else []

    def versions(self) -> list[int]:
        return sorted(int(x) for x in self._names("versions") if x.isdigit())

    def refresh(self) -> int:
        """Go to the last committed version, -1 if there is none."""
        self.version = max(self.versions(), default=-1)
        return self.version

    def _head(self, version: int | None = None) -> dict | None:
        version = self.version if version is None else version
        if version < 0:
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{version}").collect()))

    def manifest(self, version: int | None = None) -> DataFrame:
        """file (below data), tier, bytes, rows of the live runs of a version."""
        head = self._head(version)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{head['manifest']}") if head else self.spark.createDataFrame([], MANIFEST)

    def schema(self, version: int | None = None) -> StructType | None:
        head = self._head(version)
        return StructType.fromJson(head["schema"]) if head else None

    def rows(self, runs: DataFrame | None = None) -> DataFrame:
        """The rows of ``runs`` (file), or of all live ones; only their files are read."""
        files = [f"{self.path}/data/{r.file}" for r in (self.manifest() if runs is None else runs).select("file").collect()]  # metadata: a row a run
        schema = self.schema() or StructType()
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write each partition of ``rows`` as a run; a manifest of them."""
        attempt = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.path}/data/{attempt}")
        if not any(name.endswith(".parquet") for name in self._names(f"data/{attempt}")):
            return self.spark.createDataFrame([], MANIFEST)
        file = F.concat(F.lit(attempt + "/"), F.element_at(F.split("_metadata.file_path", "/"), -1))
        sizes = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{attempt}").groupBy(file.alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.greatest("bytes", F.lit(1)) / (1 << 20)) / F.log(F.lit(float(self.factor))))).cast("int")
        return sizes.select("file", tier.alias("tier"), "bytes", "rows")

    def _commit(self, manifest: DataFrame, schema: StructType) -> None:
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        draft, final = self._path(f"versions/.{name}"), self._path(f"versions/{self.version + 1}")
        out = self.fs.create(draft, False)
        out.write(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode())
        out.close()
        try:
            if self.fs.getScheme() == "file":
                paths = [self.jvm.java.nio.file.Paths.get(self.fs.makeQualified(p).toUri()) for p in (final, draft)]
                self.jvm.java.nio.file.Files.createLink(*paths)
            else:
                none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, final, none)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {self.version + 1} of {self.path}") from error
            raise
        finally:
            self.fs.delete(draft, False)
        self.version += 1

    def append(self, rows: DataFrame) -> None:
        """Add ``rows`` as new runs, one a partition, that no later step changes; tries again after a Conflict."""
        schema = self.schema()
        rows = rows.select(*schema.names) if schema else rows
        new = self._write(rows)
        while True:
            try:
                return self._commit(self.manifest().unionByName(new), self.schema() or rows.schema)
            except Conflict:
                self.refresh()

    def plan(self, whole: bool = True) -> DataFrame:
        """file, g: runs below the target, small tiers first, in groups that each fill a target-sized file.

        Without ``whole`` only tiers of ``factor`` runs or more are merged. A run belongs to the window of
        ``width`` bytes that it starts in. As a run has at most width - target bytes, a window holds the
        target at least; what follows the last whole window goes with it, and the tail of a tier goes with
        the next tier. So once a whole plan is carried out, at most one run is left below the target. The
        manifest has a row a run, few enough for one task.
        """
        below, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("tier", "file").rowsBetween(Window.unboundedPreceding, 0)
        runs = self.manifest().where(F.col("bytes") < self.target)
        if not whole:
            runs = runs.withColumn("n", F.count("*").over(Window.partitionBy("tier"))).where(F.col("n") >= self.factor)
        width = self.target + F.max("bytes").over(below)
        last = F.greatest(F.lit(1), F.floor(F.sum("bytes").over(below) / width)) - 1
        group = runs.withColumn("g", F.least(F.floor((F.sum("bytes").over(order) - F.col("bytes")) / width), last).cast("int"))
        return group.withColumn("k", F.count("*").over(Window.partitionBy("g"))).where("k > 1").select("file", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("g")).alias("g"))

    def compact(self, whole: bool = True) -> bool:
        """Merge what the plan says in one job, a task a group, and commit; False if there is nothing to merge.

        If another writer commits first, the merge is dropped: its runs have no version.
        """
        plan = self.spark.createDataFrame(self.plan(whole).collect(), "file string, g int")  # metadata: a row a run
        n = plan.count()
        if not n:
            return False
        rows = self.rows(plan)
        file, g, own = unused(rows, "_file", "_g", "_own")
        side = plan.select(F.col("file").alias(file), F.col("g").alias(g))
        named = rows.withColumn(own, F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -2, 2)))
        merged = named.join(F.broadcast(side) if n <= FEW else side, F.col(own) == F.col(file))
        groups = plan.agg(F.max("g")).first()[0]
        new = self._write(merged.repartitionById(groups, F.col(g) - 1).select(*rows.columns))
        self._commit(self.manifest().join(plan, "file", "left_anti").unionByName(new), self.schema())
        return True

    def expire(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` versions, and runs that only those name."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return
        files = lambda vs: {r.file for v in vs for r in self.manifest(v).select("file").collect()}
        dead, heads = files(old) - files(kept), [self._head(v) for v in old]
        for v in old:
            self.fs.delete(self._path(f"versions/{v}"), False)
        for head in heads:
            self.fs.delete(self._path(f"manifests/{head['manifest']}"), True)
        for file in dead:
            self.fs.delete(self._path(f"data/{file}"), False)

    def sweep(self, older_than_seconds: float = 86_400.0) -> int:
        """Delete attempts that no version names, unless they may still be under way; how many."""
        live = {r.file.split("/")[0] for v in self.versions() for r in self.manifest(v).select("file").collect()}
        heads, n = {self._head(v)["manifest"] for v in self.versions()}, 0
        before = self.jvm.java.lang.System.currentTimeMillis() - int(older_than_seconds * 1000)
        for folder, keep in (("data", live), ("manifests", heads)):
            for name in self._names(folder):
                if name not in keep and self.fs.getFileStatus(self._path(f"{folder}/{name}")).getModificationTime() <= before:
                    self.fs.delete(self._path(f"{folder}/{name}"), True)
                    n += 1
        return n


def stored(arrivals: list[DataFrame], path: str, target: int = TARGET) -> ShardStore:
    """Append each arrival to the store at ``path``, merge tiers that have filled up, and at the end all there is to merge.

    All columns are kept, whatever their names (but Spark's own ``_metadata``); null texts and ids and
    repeated rows are rows like others; very long texts are never cut. Empty arrivals: a version without new runs.
    """
    store = ShardStore(arrivals[0].sparkSession, path, target)
    for rows in arrivals:
        store.append(rows)
        while store.compact(whole=False):
            store.expire()
    while store.compact():
        store.expire()
    return store


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_md5, lang, source, n_chars of every document, read from the live shards, and the manifest's sum of rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    files = sorted(docs.inputFiles())
    arrivals = [spark.read.schema(docs.schema).parquet(*files[k::ARRIVALS]) for k in range(min(ARRIVALS, len(files)))]
    store = stored(arrivals or [docs], scratch_path(spark, "shards"))
    live = store.manifest().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return store.rows().select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "lang", "source", "n_chars", F.lit(live).cast("long").alias("live_rows"))


QUERIES = {"op4_tiered_shards": query}
ORACLES = {"op4_tiered_shards": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source, n_chars, (SELECT count(*) FROM documents) AS live_rows FROM documents"}
