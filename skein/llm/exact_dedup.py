"""Exact deduplication with two passes over a Bloom filter, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._work import Workspace, attach

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a word of the filter takes in a hash table: key, 64 bits, and what the table adds.
_WORD_BYTES = 32


def probe(rows: DataFrame, filter_words: DataFrame) -> DataFrame:
    """rows (word, mask, ...) with `maybe`: whether the filter has all bits of their masks. The
    filter's words are broadcast, no row moves."""
    found = rows.join(F.broadcast(filter_words), "word", "left")
    return found.withColumn("maybe", F.coalesce(F.col("set").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))).drop("word", "mask", "set")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_broadcast_mb: float = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id
    stays. A hash gives each text a 64-bit word of a Bloom filter and two bits in it. The first
    pass counts how many rows have the same word and bits and sets the bits that several have;
    what moves is word and bits, combined within tasks. The second pass looks each row up in the
    filter. Rows that it has are possibly repeated: only these shuffle to be grouped. All others
    pass straight through, at any size: a filter of more than max_broadcast_mb is cut into
    ranges of words of that size, broadcast one after another, and as rows are stored in the
    order of their words, each round reads its own range.

    Null texts count as empty. Rows that repeat a doc_id and text stay or go together. A null
    doc_id is smaller than any other; a group of none but null ids keeps all. Other columns are
    not read. An empty table gives no rows.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    total = docs.count()
    words = 1 << max(4, (bits_per_row * max(total, 1) - 1).bit_length() - 6)
    per_round = 1 << max(0, int((max_broadcast_mb * (1 << 20)) // _WORD_BYTES).bit_length() - 1)
    with Workspace(docs.sparkSession, "exact-dedup") as w:
        digest = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
        places = F.xxhash64("text_sha256", F.lit(1))
        bits = [F.expr(f"shiftleft(1L, cast(shiftright(places, {6 * k}) & 63 AS int))") for k in (0, 1)]
        rows = digest.withColumn("word", F.pmod(F.xxhash64("text_sha256"), F.lit(words))).withColumn("places", places)
        rows = rows.select("doc_id", "text_sha256", "word", bits[0].bitwiseOR(bits[1]).alias("mask"))
        rows = w.stage(rows if words <= per_round else rows.sortWithinPartitions("word"))
        several = rows.groupBy("word", "mask").count().filter("count > 1")
        marks = w.stage(several.groupBy("word").agg(F.bit_or("mask").alias("set")))
        if words > per_round:
            rounds = [F.col("word").between(at, at + per_round - 1) for at in range(0, words, per_round)]
            rows = reduce(DataFrame.unionByName, [w.stage(probe(rows.filter(r), marks.filter(r))) for r in rounds])
        else:
            rows = w.stage(probe(rows, marks))
        again = rows.filter("maybe").drop("maybe")
        groups = w.stage(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        once = rows.filter("NOT maybe").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        out = once.unionByName(attach(again, groups, "text_sha256", "group_size", total))
        return w.keep(out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
