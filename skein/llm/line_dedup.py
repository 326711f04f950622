"""Line deduplication by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._work import Workspace, attach, fresh


def repeated_lines(w: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, gone): the sorted places of the lines that later occurrences of a window cover.

    A window is `size` consecutive lines of a text; its first occurrence is that with the
    smallest (doc_id, place), and all others are later ones."""
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)
    taken = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines")).filter(F.col("doc_id").isNotNull() & (F.size("lines") >= size))
    # each line's hash seeds the next one's: what makes h2 another function has to come first
    key = "xxhash64({}" + ", ".join(f"lines[i + {k}]" for k in range(size)) + ")"
    made = F.expr(f"transform(sequence(0, size(lines) - {size}), i -> named_struct('h1', {key.format('')}, 'h2', {key.format('7, ')}, 'place', i))")
    windows = w.stage(taken.select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*"))
    key = F.struct("h1", "h2")
    groups = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = w.stage(groups.select(key.alias("key"), F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("first_place"), "n"))
    later = attach(windows.select(key.alias("key"), "doc_id", "place"), groups, "key", "n", windows.count())
    later = later.filter("n > 1 AND NOT (doc_id = first_doc AND place = first_place)")
    cover = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (size - 1)))))
    return later.groupBy("doc_id").agg(F.collect_set("place").alias("places")).select("doc_id", F.array_sort(cover).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, counts: bool = True) -> DataFrame:
    """docs with the lines gone that later occurrences of a repeated window of `size` lines
    cover, and two columns more: n_lines, n_removed; not these without counts. All rows and other
    columns stay.

    Lines are what newlines separate, compared exactly, empty ones too; windows never cross
    texts. Texts of fewer than `size` lines and null texts stay as they are (a null has 0 lines).
    All of a text may go; it is then empty. Rows that repeat a doc_id are one text's
    occurrences at the same places: they count as one occurrence. Rows with a null doc_id stay
    as they are. With counts, columns of docs named n_lines or n_removed are replaced; no other
    name clashes. An empty table gives no rows.
    """
    id_, gone_ = fresh(docs, "line_doc", "line_gone")
    with Workspace(docs.sparkSession, "line-dedup") as w:
        gone = w.keep(repeated_lines(w, docs, id_col, text_col, size).select(F.col("doc_id").alias(id_), F.col("gone").alias(gone_)))
    docs = docs.drop("n_lines", "n_removed") if counts else docs
    joined = docs.join(gone, docs[id_col] == gone[id_], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_))
    text = F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    kept = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        kept.append(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"))
        kept.append(F.coalesce(F.size(gone_), F.lit(0)).alias("n_removed"))
    return joined.select(kept)
