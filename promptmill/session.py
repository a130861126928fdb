"""A session with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "promptmill", master: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """Get or make a session: UTC, adaptive execution, skew-join handling. ``conf`` adds settings (dots as __).

    ``shared`` (or PROMPTMILL_SHARED) is the folder for staged tables, which all executors must see; a cluster needs it.
    """
    builder = SparkSession.builder.appName(name)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shared or "PROMPTMILL_SHARED" in os.environ:
        base["spark.checkpoint.dir"] = shared or os.environ["PROMPTMILL_SHARED"]
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
