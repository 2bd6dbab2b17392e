"""A session for local runs; on a cluster the caller's session is used."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | None = None) -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    out = SparkSession.builder.master(f"local[{n}]").appName("plumbline").config(map=conf).getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
