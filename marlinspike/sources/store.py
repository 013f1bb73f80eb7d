"""Stored indexes: tables made once from a folder's files and read until a file changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlinspike.plans import workspace


def stamp(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of all files under the paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        files = where.getFileSystem(conf).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


class Store:
    """Tables under one stamp in the session's shared folder, deleted when the driver ends.

    A table counts as there when its writing was completed; one whose writer was lost
    is written again.
    """

    def __init__(self, spark: SparkSession, name: str, mark: str):
        self.spark = spark
        self.root = f"{workspace.shared_dir(spark)}/marlinspike-index/{spark.sparkContext.applicationId}/{name}-{mark}"
        workspace.keep_until_end(spark, self.root)

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)
