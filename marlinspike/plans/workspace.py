"""Tables that cut lineage, written to the folder all executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is unset
(local tests) a temporary folder is made and set.  Written Parquet survives the
loss of any executor and is smaller than an RDD checkpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Where there is none a local session gets a temporary one; on a cluster that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="marlinspike-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Workspace:
    """Written intermediate tables of one operator call.

    ``write`` runs the plan and returns a reader over the written files;
    ``drop`` deletes a table that no later step reads.  What the result still
    reads is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marlinspike/{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        _live[self.root] = spark

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.options(compression="zstd", **options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._workspace_path = path  # noqa: SLF001 - lets drop() find it again
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_workspace_path", None)
            if path:
                _delete(self.spark, path)


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    _live[path] = spark


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for root, spark in _live.items():
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
