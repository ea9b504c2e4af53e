"""Session settings used by tests and the benchmark; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, app: str = "cadenza") -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{n}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(n))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             # small local data, heavy expressions: keep all cores busy instead of merging partitions
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
             .config("spark.sql.files.openCostInBytes", "65536")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
