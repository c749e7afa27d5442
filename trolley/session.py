"""Spark sessions with the settings that the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; everything else is the cluster's own."""
    builder = SparkSession.builder.appName("trolley")
    builder = builder.master(master) if master else builder
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()
