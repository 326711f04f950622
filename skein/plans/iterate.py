"""Driver loops over DataFrames: cutting lineage, convergence, and the vertex-program API."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds between two cuts of the lineage where rounds are cheap.
EVERY = 4


_local_dir: list[str] = []


def _folder(spark: SparkSession) -> str:
    """This session's folder in the one that driver and executors share: spark.checkpoint.dir, or
    one of its own in a session within one process, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local_dir:
            _local_dir.append(tempfile.mkdtemp(prefix="skein-"))
        root = f"file://{_local_dir[0]}"
    return f"{root.rstrip('/')}/skein-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a stored table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df computed once and stored in the checkpoint folder, which all executors share: a table, so
    plans start anew and neither lineage nor what the optimizer knows of earlier rounds grows.
    instead_of is what an earlier cut() returned and nothing needs any more; it is deleted."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if instead_of is not None:
        delete(spark, instead_of.skein_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.skein_path = path
    return out


#: Up to so many rows are taken by a sorted list in each task.
LISTED = 10_000


def smallest(rows: DataFrame, n: int, key: Column, *ties: str) -> DataFrame:
    """The n rows that key, a 64-bit hash, and then ties order first, in no order. Counts by the key's first 16 bits
    tell which rows are taken; only those with the bits at which n is reached are ordered, so no
    task holds n rows."""
    if n <= LISTED:
        return rows.orderBy(key, *ties).limit(n)
    marked = cut(rows.withColumns({"__key": key, "__bits": F.shiftright(key, 48)}))
    seen, last = 0, None
    for bits, count in sorted((r["__bits"], r["n"]) for r in marked.groupBy("__bits").agg(F.count("*").alias("n")).collect()):  # 65,536 at most
        if seen + count > n:
            last = bits
            break
        seen += count
    if last is None:
        return marked.drop("__key", "__bits")
    edge = marked.filter(F.col("__bits") == last).orderBy("__key", *ties).limit(n - seen)
    return marked.filter(F.col("__bits") < last).unionByName(edge).drop("__key", "__bits")


_notes: ContextVar[dict | None] = ContextVar("notes", default=None)


@contextmanager
def noted() -> Iterator[dict]:
    """Collects what operators note() while they run."""
    found: dict = {}
    token = _notes.set(found)
    try:
        yield found
    finally:
        _notes.reset(token)


def note(**facts) -> None:
    """What a loop knows besides its result: rounds run, whether it converged, and the like."""
    found = _notes.get()
    if found is not None:
        found.update(facts)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], max_rounds: int | None = None) -> DataFrame:
    """Repeats state, changed = step(state, round) until changed is empty."""
    k = 0
    while max_rounds is None or k < max_rounds:
        state, changed = step(state, k)
        k += 1
        if is_empty(changed):
            break
    return state


def pregel(
    nodes: DataFrame,
    edges: DataFrame,
    init: dict[str, Column],
    message: Column,
    reducer: Callable[[str], Column],
    update: dict[str, Column],
    max_iterations: int,
    send_if: Column | None = None,
    to_incoming: bool = False,
    targets: Column | None = None,
    master: Callable[[DataFrame, int], bool] | None = None,
) -> DataFrame:
    """A synchronous vertex program on DataFrames.

    nodes has `id` and any columns; edges has `src`, `dst`, `weight`. `init` makes the vertex
    state. Each superstep sends `message`, an expression over the sender's state and `weight`,
    along every edge whose sender satisfies `send_if` (None: all); messages to one node are
    combined by `reducer("message")`, as sum, min, max, count or collect_list; then each
    column of `update` is computed over the state, `message` (null if none came) and
    `superstep`. It ends when no node satisfies `send_if`, or after max_iterations supersteps.
    With targets, an array of ids over the sender's state, messages go to these nodes and not
    along edges. master sees the state after each superstep and ends the program by True.
    """
    state = nodes.select("*", *(c.alias(n) for n, c in init.items()))
    out, into = ("dst", "src") if to_incoming else ("src", "dst")
    stored = None
    links = cut(edges.select(F.col(out).alias("__from"), F.col(into).alias("__to"), "weight"))
    for k in range(max_iterations):
        senders = state if send_if is None else state.filter(send_if)
        if k % EVERY == EVERY - 1:
            state = stored = cut(state, stored)
            senders = state if send_if is None else state.filter(send_if)
            if is_empty(senders):
                break
        if targets is None:
            sent = senders.join(links, senders["id"] == links["__from"]).select("__to", message.alias("message"))
        else:
            sent = senders.select(F.explode(targets).alias("__to"), message.alias("message"))
        inbox = sent.groupBy("__to").agg(reducer("message").alias("message"))
        joined = state.join(inbox, state["id"] == inbox["__to"], "left").withColumn("superstep", F.lit(k))
        state = joined.select(*(update[c].alias(c) if c in update else F.col(c) for c in state.columns))
        if master is not None:
            state = stored = cut(state, stored)
            if master(state, k):
                break
    return state
