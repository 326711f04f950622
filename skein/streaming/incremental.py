"""Graphs kept up to date from streams of relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.community import contracted_labels
from skein.plans.iterate import delete


class StreamedComponents:
    """Connected components (id, component) under relationships that arrive in micro-batches. A
    batch's components are found over the old names of its ends, so only what a batch joins is
    renamed. Each batch writes a version of its own, named after it, and reads the last complete
    one before it: so a stream that starts again from its checkpoint, in whatever process, goes on
    where it was, and a batch that runs again gives the same labels. The version before the one
    read is dropped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        """The complete versions, in order."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def _read(self, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], "id long, component long")
        return self.spark.read.schema("id long, component long").parquet(f"{self.path}/{versions[-1]}")

    @property
    def labels(self) -> DataFrame:
        return self._read(self._versions())

    def update(self, batch: DataFrame, epoch: int) -> None:
        edges = batch.select(F.col("sourceNodeId").alias("src"), F.col("targetNodeId").alias("dst")).distinct()
        before = [v for v in self._versions() if v < epoch]
        old = self._read(before)
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        known = old.unionByName(ends.join(old, "id", "left_anti").withColumn("component", F.col("id")))
        renamed = edges.join(known.toDF("src", "a"), "src").join(known.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        merged = contracted_labels(renamed).toDF("component", "to")
        new = known.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        new.write.mode("overwrite").parquet(f"{self.path}/{epoch}")
        for v in before[:-1]:
            delete(self.spark, f"{self.path}/{v}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def streamed_degrees(stream: DataFrame) -> DataFrame:
    """Out-degrees (nodeId, degree) of a stream of relationships, as a running aggregate."""
    return stream.groupBy(F.col("sourceNodeId").alias("nodeId")).agg(F.count("*").alias("degree"))
