"""Shared scratch space: where operators cut lineage with written tables.

All executors and the driver must see the folder, so it is taken from
``spark.checkpoint.dir``; only a local-mode session may fall back to a
temporary folder of this machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode one is made when unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="grove-"))
        atexit.register(__import__("shutil").rmtree, _local[0], True)
    return "file://" + _local[0]


_made: list[Scratch] = []


def clear() -> None:
    """Delete every folder that operators of this process have made, once no result that reads them is needed any more."""
    while _made:
        made = _made.pop()
        made.drop("")


class Scratch:
    """Tables of one run of an operator, below one folder of the shared space.

    ``write`` makes a DataFrame durable and returns it reread, so that a lost
    executor never recomputes what stands before it. ``drop`` deletes a table
    that nothing will read again; what a result reads goes with ``clear``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/grove-{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame, bytes_each: int, least: int | None = None) -> int:
    """Partitions so that each gets about ``bytes_each`` of the plan's estimated input."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-size // bytes_each)))
