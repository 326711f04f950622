"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm._work import Workspace

_BLOCK = "block long, part long, bucket long, dim int, n int, longest double, ids binary, data binary"
_FOUND = "query_id long, vec_id long, score long"


def _quantised(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None where it is null or holds null or non-finite."""
    out = []
    for v in column:
        x = None if not v.is_valid else np.array([np.nan if c is None else c for c in v.as_py()], float)
        with np.errstate(over="ignore"):
            x = None if x is None or not np.isfinite(x).all() else np.floor(scale * x)
        out.append(x if x is not None and np.isfinite(x).all() else None)
    return out


def vectors(rows: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, dim, norm, data, asked): quantised vectors as float64 bytes, which hold them exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            columns = (batch.column(id_col).to_pylist(), _quantised(batch.column(vector_col), scale), batch.column("asked").to_pylist())
            for i, x, asked in zip(*columns):
                if x is not None and i is not None:
                    unit = 2.0**500 if x.size and np.abs(x).max() > 1e150 else 1.0  # squares stay finite
                    found.append((i, len(x), float(np.sqrt(np.square(x / unit).sum()) * unit), x.tobytes(), asked))
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 5, kinds)], ["vec_id", "dim", "norm", "data", "asked"])

    asked = F.coalesce(is_query, F.lit(False)).alias("asked")
    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col), asked).mapInArrow(run, "vec_id long, dim int, norm double, data binary, asked boolean")


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block, its vectors from the longest to the shortest."""
    norms = rows.column("norm").to_numpy()
    order = np.argsort(-norms, kind="stable")
    rows = rows.take(pa.array(order))
    return pa.table({
        "block": rows.column("block")[:1], "part": rows.column("part")[:1], "bucket": rows.column("bucket")[:1], "dim": rows.column("dim")[:1],
        "n": pa.array([len(order)], pa.int32()), "longest": pa.array([float(norms.max())]),
        "ids": pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()),
        "data": pa.array([b"".join(rows.column("data").to_pylist())], pa.binary()),
    })


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: in float64 while sums stay under 2 ** 53, else
    with Python's integers, cut to 64 bits."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    return np.array([[max(-(2**63), min(2**63 - 1, int(v or 0))) for v in r] for r in exact], np.int64).reshape(len(q), len(x))


def search_block(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, focus: int = 4, coordinate_from: float = 0.6) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best vectors of one block (rows of x from long to short) among those
    scoring `least` or more; ties to smaller ids. A query's local threshold is the cosine that a
    vector as long as the block's longest needs. Above 1 the block is skipped. From
    coordinate_from on, unit vectors must lie between bounds on the query's `focus` largest
    coordinates; below, only vectors long enough are taken. What is left is multiplied out."""
    norms, lengths = np.sqrt(np.square(x).sum(1)), np.sqrt(np.square(q).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = least / (lengths * norms.max(initial=0))
        needed = least / lengths
    local, needed = np.nan_to_num(local, nan=-1.0, posinf=np.inf, neginf=-np.inf) * (1 - 1e-9) - 1e-9, np.nan_to_num(needed, nan=-1.0, posinf=np.inf, neginf=-np.inf) * (1 - 1e-9) - 1e-9
    upto = np.searchsorted(-norms, -needed, "right")
    by_length = np.flatnonzero((local <= 1) & (local < coordinate_from) & (upto > 0))
    scores = _products(q[by_length], x[: upto[by_length].max(initial=0)])
    row = dict(zip(by_length.tolist(), range(len(by_length))))
    units = x / np.maximum(norms, 1e-300)[:, None]
    for i in np.flatnonzero(local <= 1).tolist():
        if i in row:
            keep, got = np.arange(upto[i]), scores[row[i], : upto[i]]
        elif local[i] >= coordinate_from:
            unit, c = q[i] / lengths[i], min(local[i], 1.0)
            near = np.arange(upto[i])
            for f in np.argsort(-np.abs(unit))[:focus]:
                reach = np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - unit[f] ** 2)) + 1e-9
                value = units[near, f]
                near = near[(value >= unit[f] * c - reach) & ((value <= unit[f] * c + reach) | (unit[f] > c))] if unit[f] >= 0 else near[(value <= unit[f] * c + reach) & ((value >= unit[f] * c - reach) | (-unit[f] > c))]
            keep, got = near, _products(q[i : i + 1], x[near])[0]
        else:
            continue
        good = (got >= least[i]) & (ids[keep] != q_ids[i])
        keep, got = ids[keep[good]], got[good]
        if len(got) > k:
            cut = np.partition(got, len(got) - k)[len(got) - k]
            keep, got = keep[got >= cut], got[got >= cut]
        best = np.lexsort((keep, -got))[:k]
        yield i, keep[best], got[best]


def block_pairs(queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(q_block, block) of the blocks that a block of queries has to meet: of the lengths of its
    dimension that reach the least one `needed`. A length's blocks are numbered, so no block is
    looked up, and no pair is made that is dropped later."""
    reached = queries.select("q_block", "dim", "needed").join(F.broadcast(sizes), "dim").filter(F.col("longest") >= F.col("needed"))
    pairs = reached.select("q_block", "dim", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return pairs.select("q_block", F.xxhash64("dim", "bucket", "part").alias("block"))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is_query marks the k other rows with
    the largest integer inner products of floor(scale * x), ties to the smaller id.

    Vectors are grouped by length, in steps of a twentieth, and a length's vectors are dealt into
    blocks of about `block`. Queries first meet the longest block of their dimension, which gives
    each a score it must reach. A block of queries then meets only blocks of lengths in which one
    of its queries could still reach its score; these pairs are told from lengths alone, before
    any vector moves, and search_block() prunes within them.

    Vectors that are null, or hold null or non-finite components, or whose id is null, take no
    part; only vectors of equal dimension are compared. A query without candidates has no
    row. Rows that repeat an id are candidates each, but a query's own id is never its result; a
    repeated id with different vectors asks with each. is_query is any condition on the columns of
    rows; null is no query.
    Scores beyond 64 bits are cut to them. Other columns are not read; an empty table gives none.
    """
    spark = rows.sparkSession
    with Workspace(spark, "top-k") as w:
        stored = w.stage(vectors(rows, is_query, id_col, vector_col, scale))
        bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.log(F.lit(1.05)))).otherwise(-100_000).cast("long")
        keyed = stored.withColumn("bucket", bucket)
        # the number of lengths is bounded by the range of doubles, about 30,000 a dimension
        sizes = keyed.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
        sizes = w.stage(sizes.select("dim", "bucket", "longest", F.ceil(F.col("n") / block).cast("long").alias("parts")))
        keyed = keyed.join(F.broadcast(sizes.select("dim", "bucket", "parts")), ["dim", "bucket"])
        # rows of one id are dealt over all blocks of their length, too
        keyed = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "parts")).withColumn("block", F.xxhash64("dim", "bucket", "part"))
        blocks = w.stage(keyed.select("block", "part", "bucket", "dim", "vec_id", "norm", "data").groupBy("block").applyInArrow(_block, _BLOCK))
        asked = w.stage(stored.filter("asked").dropDuplicates(["vec_id", "data"]))
        n_parts = max(1, -(-asked.count() // query_block))
        asked = asked.withColumns({"part": F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)), "bucket": F.lit(0).cast("long")}).withColumn("block", F.xxhash64("dim", "part"))
        queries = w.stage(asked.select("block", "part", "bucket", "dim", "vec_id", "norm", "data").groupBy("block").applyInArrow(_block, _BLOCK))
        queries = queries.select(F.col("block").alias("q_block"), "part", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                with_goal = "least" in batch.schema.names
                for r in range(batch.num_rows):
                    # views of the batch's bytes, not copies
                    q_ids, ids = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("q_ids", "ids"))
                    dim = batch.column("dim")[r].as_py()
                    q, x = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(n, dim) for c, n in (("q_data", len(q_ids)), ("data", len(ids))))
                    least = np.frombuffer(batch.column("least")[r].as_buffer()) if with_goal else np.full(len(q_ids), -np.inf)
                    out = [(q_ids[i], v, s) for i, found, got in search_block(q, q_ids, least, x, ids, k) for v, s in zip(found, got)]
                    a, b, c = zip(*out) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["query_id", "vec_id", "score"])

        # the longest block of a dimension, once for each part of the queries
        leader = blocks.groupBy("dim").agg(F.max_by("block", F.struct("longest", "block")).alias("block"))
        leader = leader.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long")))).join(blocks.select("block", "ids", "data"), "block")
        first = queries.join(leader, ["dim", "part"]).select("q_ids", "q_data", "dim", "ids", "data").mapInArrow(run, _FOUND)
        least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        # back to the blocks of queries: their scores in the order of their ids
        per = asked.select(F.col("block").alias("q_block"), F.col("vec_id").alias("query_id")).distinct().join(least, "query_id", "left")
        per = per.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "least"))).alias("goal"))

        def with_goals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                goals, needed = [], []
                for ids, data, dim, goal in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_data", "dim", "goal"))):
                    goal, ids = dict(goal), np.frombuffer(ids, np.int64)
                    least = np.array([-np.inf if goal[i] is None else float(goal[i]) for i in ids.tolist()])
                    lengths = np.sqrt(np.square(np.frombuffer(data).reshape(len(ids), dim)).sum(1))
                    goals.append(least.tobytes())
                    with np.errstate(divide="ignore", invalid="ignore"):
                        each = np.where(least <= 0, -np.inf, least / lengths)  # at least so long; any if 0 is enough
                    needed.append(float(np.nan_to_num(each, nan=-np.inf, posinf=np.inf, neginf=-np.inf).min()) * (1 - 1e-9))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q_block", "dim", "q_ids", "q_data")), pa.array(goals, pa.binary()), pa.array(needed, pa.float64())], ["q_block", "dim", "q_ids", "q_data", "least", "needed"])

        queries = w.stage(queries.join(per, "q_block").mapInArrow(with_goals, "q_block long, dim int, q_ids binary, q_data binary, least binary, needed double"))
        met = block_pairs(queries, sizes).join(queries.drop("dim", "needed"), "q_block")
        met = met.hint("merge").join(blocks.select("block", "dim", "ids", "data"), "block")
        found = w.keep(met.select("q_ids", "q_data", "least", "dim", "ids", "data").mapInArrow(run, _FOUND))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
