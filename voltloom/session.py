"""Session settings for tests and benchmarks; a cluster's own settings come first there."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: int | str = 8, partitions: int = 8, name: str = "voltloom", memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
