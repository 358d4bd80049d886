"""A session with the settings this library is tuned for; any other session works too."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "corvidex", **extra: str) -> SparkSession:
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    builder = SparkSession.builder.appName(name).config(map=conf)
    if master := master or os.environ.get("CORVIDEX_MASTER"):
        builder = builder.master(master)
    return builder.getOrCreate()
