"""Cutting the lineage of iterations with tables in the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame

_written: list = []


@atexit.register
def drop_steps() -> None:
    """Delete the tables of this process; results that still read one must be written first."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return


def cut(df: DataFrame) -> DataFrame:
    """``df``, written and read again: below spark.checkpoint.dir, or a local folder where it is unset in a local session."""
    spark = df.sparkSession
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(root or 'file:///tmp/checkpoints/trolley').rstrip('/')}/steps-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files of the plan that has run go with it
    return spark.read.schema(df.schema).parquet(path)
