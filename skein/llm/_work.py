"""Tables, scratch space and skew-safe joins shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot from this share of all rows on; so there are at most this many hot groups.
HOT_GROUPS = 1000

_local_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set. Only a
    session within one process, as in tests, does without."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="skein-"))
    return f"file://{_local_dir[0]}"


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


class Workspace:
    """Intermediate tables in the shared folder. Those made by stage() go at the end of the
    with-block, those made by keep() stay for whoever uses the result."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.temp, self.kept, self.n = f"{root}/temp", f"{root}/kept", 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.temp)
        path.getFileSystem(conf).delete(path, True)
        free_shuffles(self.spark)

    def _write(self, df: DataFrame, folder: str) -> DataFrame:
        self.n += 1
        path = f"{folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stage(self, df: DataFrame) -> DataFrame:
        return self._write(df, self.temp)

    def keep(self, df: DataFrame) -> DataFrame:
        return self._write(df, self.kept)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    end = ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with groups, one row for each key and its number of rows in `size`.
    The sizes add up to `total` at most, so at most HOT_GROUPS groups are hot; these few are
    broadcast, and only rows of other groups shuffle. Both frames should be stored tables."""
    hot = groups.filter(F.col(size) * HOT_GROUPS >= total)
    cold = groups.filter(F.col(size) * HOT_GROUPS < total)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(cold, key, "left"))


def components(w: Workspace, edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); a component's name is its smallest id.

    Each round every node points at its smallest neighbour, pointers are followed once more,
    and edges are contracted; stored after each round, edges at least halve in nodes."""
    # One row a direction: the smallest neighbour is a partial aggregate, and joins on hubs
    # read stored tables on both sides, so that adaptive execution can split them.
    edges = w.stage(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = F.explode(F.array("a", "b")).alias("id")
    labels = w.stage(edges.select(ends).distinct().withColumn("component", F.col("id")))
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = w.stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")))
        up = to.select(F.col("a").alias("to"), F.col("to").alias("up"))
        to = w.stage(to.join(up, "to", "left").select("a", F.coalesce("up", "to").alias("to")))
        by_a = to.withColumnRenamed("to", "new_a")
        by_b = to.select(F.col("a").alias("b"), F.col("to").alias("new_b"))
        half = w.stage(edges.join(by_a, "a").select("b", F.col("new_a").alias("a")))
        edges = w.stage(half.join(by_b, "b").select(F.least("a", "new_b").alias("a"), F.greatest("a", "new_b").alias("b")).filter("a != b").distinct())
        moved = to.select(F.col("a").alias("component"), "to")
        labels = w.stage(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
    return labels
