"""Depth and root of nodes that arrive in a stream.

A node joins the table as soon as its parent is known or comes in the same
batch; until then it waits. Each micro-batch is resolved by one fold over its
own nodes, whose topmost ones start from their parents' rows, so the work
follows the batch and not the tree. A batch writes a folder of its own, so one
that is repeated after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grove.plans.folds import down
from grove.plans.scratch import cut

_NODES = "tree_id long, id long, ancestor_id long"
_KNOWN = f"{_NODES}, node_depth long, root_id long, batch long"


class LineageTable:
    """Nodes with depth and root below ``path``, and those that wait for their parents."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def nodes(self) -> DataFrame:
        return self._read("nodes", _KNOWN).drop("batch")

    def waiting(self) -> DataFrame:
        """Nodes whose parents have not come."""
        rows = self._read("waiting", f"{_NODES}, batch long").drop("batch").dropDuplicates(["tree_id", "id"])
        return rows.join(self.nodes(), ["tree_id", "id"], "left_anti")

    def add(self, batch: DataFrame, number: int) -> None:
        """Take a batch of (tree_id, id, ancestor_id); nodes that are known already are ignored."""
        known = self._read("nodes", _KNOWN).filter(F.col("batch") < number)
        before = self._read("waiting", f"{_NODES}, batch long").filter(F.col("batch") == number - 1).drop("batch")
        new = batch.select("tree_id", "id", "ancestor_id").unionByName(before).dropDuplicates(["tree_id", "id"])
        new = new.join(known, ["tree_id", "id"], "left_anti")
        parents = known.select("tree_id", F.col("id").alias("ancestor_id"), F.col("node_depth").alias("_depth"), F.col("root_id").alias("_root"))
        here = new.select("tree_id", F.col("id").alias("ancestor_id"), F.lit(True).alias("_here"))
        rows, _ = cut(new.join(parents, ["tree_id", "ancestor_id"], "left").join(here, ["tree_id", "ancestor_id"], "left"))
        root = F.col("id") == F.col("ancestor_id")
        top = root | F.col("_here").isNull()
        local = rows.select(
            "tree_id",
            "id",
            F.when(top, F.col("id")).otherwise(F.col("ancestor_id")).alias("ancestor_id"),
            F.col("ancestor_id").alias("_true"),
            F.when(root, 0).when(top, F.col("_depth") + 1).otherwise(1).cast("long").alias("_step"),
            F.when(root, F.col("id")).when(top, F.col("_root")).alias("_start"),
        )
        done, _ = cut(down(local, {"node_depth": ("_step", "sum"), "root_id": ("_start", "first")}))
        done = done.withColumn("ancestor_id", F.col("_true"))
        resolved = done.filter(F.col("root_id").isNotNull()).select("tree_id", "id", "ancestor_id", "node_depth", "root_id")
        resolved.write.mode("overwrite").parquet(f"{self.path}/nodes/batch={number}")
        done.filter(F.col("root_id").isNull()).select("tree_id", "id", "ancestor_id").write.mode("overwrite").parquet(f"{self.path}/waiting/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Feed the table from a stream of (tree_id, id, ancestor_id)."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
