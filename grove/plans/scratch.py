"""Durable intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="grove-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def cut(df: DataFrame, *, drop: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` and reread it, so that nothing before it runs again; deletes the table at ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grove-fold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if drop:
        jvm = spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(drop)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(df.schema).parquet(path), path
