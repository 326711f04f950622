"""Near-duplicate documents by bottom-k sketches of one hash function.

A text's set of word shingles is hashed by one function, and its k smallest hashes are kept.
Inverted lists of retained hashes give pairs that overlap; the sketch of the union, merged from
two sketches, estimates a pair's similarity and drops hopeless pairs; the rest are confirmed on
full shingle sets. Texts with equal sets are one class from the start, with one representative;
classes that a repeated id shares are joined.

A retained hash is rare if at most `rare` classes retain it. Two linked classes share most of
their hashes. If enough of one's hashes are rare, they share a rare one all but certainly, and
lists of rare hashes, being short, are paired off whole. Classes that have few rare hashes
are those of large groups of near copies, or little more than a very common passage. Of
these, all shingles are counted: one that a single class has is in no intersection, so
classes with too many of their own are linked with no other of them. For the rest, each list of
a common hash links its members to the one with the fewest shingles of its own, which is the
middle of a group of near copies; this costs one pair a member and joins a group. What is
still apart after that is far from the middle: it lacks common shingles. Two such classes
reach the overlap of a link by their common shingles alone, or share a shingle that few
classes have. The first are compared with the members of so many of their lists, the least
common first, that no pair with the overlap of a link escapes; the second are paired on the
short lists of their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm._text import U64, chunks, shingles
from skein.llm._work import Workspace, attach, components, fresh

_PAIR = "a long, b long, estimate double"


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text); the key tells apart the texts of a repeated id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sketches(docs: DataFrame, k: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n, set_key, sketch): a text's hash, size and digest of its shingle set, and
    its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            sizes, keys, kept = [], [], []
            for s in shingles(data, offsets, words):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                kept.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "text_key", "n", "set_key", "sketch"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_key long, n long, set_key binary, sketch binary")


def union_estimate(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, k: int) -> float:
    """Similarity from two sorted sketches: the share of both among the k smallest of the union;
    exact if both sets are retained whole."""
    both, counts = np.unique(np.concatenate([x, y]), return_counts=True)
    if n_x > k or n_y > k:
        counts = counts[:k]
    return float((counts == 2).sum()) / max(1, len(counts))


def _estimated(pairs: DataFrame, sketched: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, estimate) of the pairs whose estimate is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")}
            e = np.array([union_estimate(np.frombuffer(x, U64), np.frombuffer(y, U64), m, n, k) for x, y, m, n in zip(*column.values())])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(e, pa.float64())], ["a", "b", "estimate"]).filter(pa.array(e >= least, pa.bool_()))

    left = sketched.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = sketched.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, _PAIR)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b) of the pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                # a hub stands in many pairs: each different text is shingled once
                coded = [part.column(c).dictionary_encode() for c in ("ta", "tb")]
                sets = [[s for _, data, offsets in chunks(iter([pa.RecordBatch.from_arrays([c.dictionary], ["t"])]), "t") for s in shingles(data, offsets, words)] for c in coded]
                for i, (a, b) in enumerate(zip(*(c.indices.to_pylist() for c in coded))):
                    x, y = sets[0][a], sets[1][b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[at + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sized(percent: int, a: str = "na", b: str = "nb"):
    """Sets so different in size can't be similar enough."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _own(percent: int, a: str, b: str, own_a: str, own_b: str):
    """Not so for linked sets: an intersection is at least percent / (100 + percent) of both sizes'
    sum, and lacks what each has for itself, which the union has on top."""
    both = (F.col(a) + F.col(b)) * percent
    enough = F.least(F.col(a) - F.col(own_a), F.col(b) - F.col(own_b)) * (100 + percent) >= both
    return enough & ((F.col(own_a) + F.col(own_b)) * (100 + percent) <= (F.col(a) + F.col(b)) * (100 - percent))


def _linked(percent: int, most, a: str = "na", b: str = "nb"):
    """Whether sets can be linked whose intersection has `most` shingles at most."""
    return most * (100 + percent) >= (F.col(a) + F.col(b)) * percent


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(value, rep) of every shingle of every text."""
        for rows, data, offsets in chunks(batches, "text"):
            found = list(shingles(data, offsets, words))
            value = np.concatenate(found) if found else np.zeros(0, U64)
            rep = np.repeat(rows.column("rep").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(_as_long(value)), pa.array(rep)], ["value", "rep"])

    return run


def near_components(w: Workspace, docs: DataFrame, percent: int = 85, words: int = 5, k: int = 64, rare: int = 24, slack: float = 0.22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, component) for every row with a doc_id; see near_dedup()."""
    # merge hints: ids of candidates grow with the corpus, so they are broadcast at no size
    named = docs.filter(F.col(id_col).isNotNull())
    rows = w.stage(sketches(named, k, words, id_col, text_col))
    classes = rows.filter("n > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("size"))
    # written once, so the numbers stay
    classes = w.stage(classes.select(F.monotonically_increasing_id().alias("rep"), "set_key", "first.doc_id", "first.text_key", "size"))
    # of rows with a representative's id and text one is enough
    sketched = w.stage(rows.join(classes.select("rep", "set_key", "doc_id", "text_key").hint("merge"), ["set_key", "doc_id", "text_key"]).select("rep", "doc_id", "text_key", F.xxhash64("set_key").alias("key"), "n", "sketch").dropDuplicates(["rep"]))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(s, np.int64) for s in batch.column("sketch").to_pylist()]
            length = [len(x) for x in found]
            value = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.repeat(batch.column("rep").to_numpy(), length)), pa.array(np.repeat(batch.column("n").to_numpy(), length).astype(np.int32))], ["value", "rep", "n"])

    posts = sketched.mapInArrow(post, "value long, rep long, n int")
    lists = w.stage(posts.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    posts = w.stage(posts.join(lists, "value"))  # hashes that one class has pair nothing
    least = percent / 100 - slack

    # short lists, paired off whole: a pair's overlap is what both retain of rare hashes, and of
    # common ones at most what the one with fewer retains
    n_common = w.stage(posts.filter(F.col("df") > rare).groupBy("rep").agg(F.count("*").alias("common"), F.max("n").alias("n")))
    short = posts.filter(F.col("df") <= rare).drop("df")
    left, right = short.toDF("value", "a", "na"), short.toDF("value", "b", "nb")
    pairs = left.join(right, "value").filter((F.col("a") < F.col("b")) & _sized(percent)).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    for end in "ab":
        pairs = pairs.join(n_common.select(F.col("rep").alias(end), F.col("common").alias(f"c{end}")), end, "left")
    overlap = F.col("shared") + F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0)))
    pairs = pairs.filter(overlap >= F.floor(F.least("na", "nb", F.lit(k)) * (percent / 100 - 0.26))).select("a", "b")
    candidates = w.stage(_estimated(pairs, sketched, k, least))

    # classes with few rare hashes: of what they retain, at most 40 % is rare
    mostly = w.stage(n_common.filter(F.col("common") * 10 >= F.least(F.col("n"), F.lit(k)) * 6).select("rep"))
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(mostly).distinct()
    wanted = sketched.select("rep", "doc_id", "text_key").join(wanted.hint("merge"), "rep")
    texts = w.stage(_texts(named, id_col, text_col).join(wanted.hint("merge"), ["doc_id", "text_key"]).select("rep", "text").dropDuplicates(["rep"]))
    # a shingle that only one of them has is in no intersection: with too many of these a class
    # can't be linked with another of them, and is left out
    counted = texts.join(mostly, "rep", "left_semi").mapInArrow(_shingle_rows(words), "value long, rep long").groupBy("value").agg(F.count("*").alias("df"), F.min("rep").alias("rep"))
    own = counted.filter("df = 1").groupBy("rep").agg(F.count("*").alias("own"))
    own = mostly.join(own, "rep", "left").join(sketched.select("rep", "n", "key").hint("merge"), "rep").select("rep", "n", "key", F.coalesce("own", F.lit(0)).alias("own"))
    able = w.stage(own.filter(F.col("own") * 100 <= F.col("n") * (100 - percent)))
    common = w.stage(posts.filter(F.col("df") > rare).select("value", "rep").join(able, "rep"))
    # one member of each list, that with the fewest shingles of its own, is paired with all others;
    # ties go the same way in all lists, so that lists of a group agree on it
    hub = common.groupBy("value").agg(F.min(F.struct("own", "key", "rep", "n")).alias("h"), F.count("*").alias("size"))
    hub = w.stage(hub.select("value", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.own").alias("hub_own"), "size"))
    starred = attach(common, hub, "value", "size", common.count()).filter("rep <> hub").filter(_sized(percent, "n", "hub_n") & _own(percent, "n", "hub_n", "own", "hub_own"))
    stars = starred.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    stars = _estimated(stars.join(candidates.select("a", "b"), ["a", "b"], "left_anti"), sketched, k, least)
    candidates = w.stage(candidates.unionByName(stars))

    # first each class and its likeliest smaller partner: that joins most groups
    best = F.row_number().over(W.partitionBy("b").orderBy(F.desc("estimate"), "a"))
    first = candidates.withColumn("k", best).filter("k = 1")
    edges = w.stage(_confirmed(first, texts, percent, words))
    found = components(w, edges)
    # then what is still apart
    apart = _apart(candidates.join(first.select("a", "b"), ["a", "b"], "left_anti"), found)
    edges = w.stage(edges.unionByName(_confirmed(apart, texts, percent, words)))
    found = components(w, edges)

    # Classes with few rare hashes that are still apart. Pairs that share a rare hash are decided; of
    # other linked pairs both retain at least `need` common ones. In one order of all values, the
    # first that they share is then among all but the last need - 1 of each.
    if common.limit(1).count():
        share = F.lit(percent / 100 - 0.26)
        need = F.greatest(F.floor(F.least(F.ceil(F.col("n") * percent / 100), F.lit(k)) * share), F.lit(1)).cast("int")
        ranked = attach(common, hub.select("value", "size"), "value", "size", common.count())
        held = F.transform(F.array_sort(F.collect_list(F.struct("size", "value"))), lambda x: x["value"])
        # where a class's shingles are in few sets, they are looked at in full
        few = texts.join(able, "rep", "left_semi").mapInArrow(_shingle_rows(words), "value long, rep long")
        few_lists = w.stage(few.groupBy("value").agg(F.count("*").alias("df"), F.min("rep").alias("rep")).filter(F.col("df") <= rare))
        few = w.stage(few.join(few_lists.filter("df > 1").select("value").hint("merge"), "value"))
        n_few = few.select("rep").unionByName(few_lists.filter("df = 1").select("rep")).groupBy("rep").agg(F.count("*").alias("few"))
        state = able.join(n_few, "rep", "left").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        state = w.stage(state.select("rep", "n", F.coalesce("component", "rep").alias("c"), (F.col("n") - F.coalesce("few", F.lit(0))).alias("many")))
        sets = ranked.groupBy("rep").agg(held.alias("held")).join(state, "rep").filter(F.size("held") >= need)
        part = w.stage(sets.select(F.explode(F.slice("held", F.lit(1), F.size("held") - need + 1)).alias("value"), "*"))
        by_part = w.stage(part.groupBy("value", "c").agg(F.count("*").alias("members")))
        largest = by_part.groupBy("value").agg(F.max(F.struct("members", "c")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
        largest = w.stage(largest.select("value", F.col("m.c").alias("largest")))
        alone = w.stage(part.join(largest, "value").filter("c <> largest").select("value", "largest", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("many").alias("ma"), F.col("held").alias("mine")))
        # an intersection as large as a link's without a shingle that few have
        met = alone.join(part.select("value", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("many").alias("mb"), "held"), "value")
        # once if both are alone, and in the first of the lists they share: an intersection keeps its first array's order
        met = met.filter((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("largest")) | (F.col("a") < F.col("b"))) & _sized(percent) & _linked(percent, F.least("ma", "mb")))
        both = F.array_intersect("mine", "held")
        met = met.filter((F.get(both, F.lit(0)) == F.col("value")) & (F.size(both) >= F.floor(F.least("na", "nb", F.lit(k)) * share))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        # or one with such a shingle: those that are too far from each other by common shingles
        ends = [few.join(state, "rep").select("value", *(F.col(c).alias(d) for c, d in (("rep", x), ("n", f"n{x}"), ("c", f"c{x}"), ("many", f"m{x}")))) for x in "ab"]
        near = ends[0].join(ends[1], "value").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _sized(percent))
        near = near.groupBy("a", "b", "na", "nb", "ma", "mb").agg(F.count("*").alias("shared")).filter(_linked(percent, F.least("ma", "mb") + F.col("shared"))).select("a", "b")
        met = met.unionByName(near).distinct().join(candidates.select("a", "b"), ["a", "b"], "left_anti")
        left_over = w.stage(_estimated(met, sketched, k, least))
        edges = w.stage(edges.unionByName(_confirmed(left_over, texts, percent, words)))
    # a document is one node, whatever texts its repeated id has
    of = w.stage(rows.filter("n > 0").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y").select("doc_id"))
    if of.limit(1).count():
        twice = rows.filter("n > 0").select("doc_id", "set_key").join(of.hint("merge"), "doc_id", "left_semi").distinct()
        twice = w.stage(twice.join(classes.select("set_key", "rep").hint("merge"), "set_key").select("doc_id", F.col("rep").alias("b")))
        one = twice.groupBy("doc_id").agg(F.min("b").alias("a"), F.count("*").alias("size"))
        edges = w.stage(edges.unionByName(attach(twice, w.stage(one), "doc_id", "size", twice.count()).select("a", "b")))
    found = components(w, edges)

    # a component's name is its smallest doc_id
    placed = w.stage(classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set_key", "size", "doc_id", F.coalesce("component", "rep").alias("c")))
    names = w.stage(placed.groupBy("c").agg(F.min("doc_id").alias("component"), F.count("*").alias("members")))
    named_classes = w.stage(attach(placed, names, "c", "members", placed.count()).select("set_key", "size", "component"))
    with_set = attach(rows.filter("n > 0").select("doc_id", "n", "set_key"), named_classes, "set_key", "size", rows.count())
    return with_set.select("doc_id", "n", "component").unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    ends = [found.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_dedup(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    A-Z is lower-cased, words are [^\\x20\\x09-\\x0D]+, a set has a text's different shingles of
    `words` words, or its whole sequence if it has fewer. Texts are linked if 100 * intersection
    >= percent * union; component_id is the smallest doc_id that links lead to.

    Null and empty texts and those without words have no shingle and are linked with nothing.
    Rows that repeat a doc_id are one document: the component holds the links of all their texts,
    and they are kept or dropped alike. A row with a null doc_id has a null
    component_id and 0 shingles and is kept. Other columns are not read. An empty table gives
    no rows.
    """
    with Workspace(docs.sparkSession, "near-dedup") as w:
        out = near_components(w, docs, percent, words, id_col=id_col, text_col=text_col)
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
        null = F.lit(None).cast("long")
        unnamed = docs.filter(F.col(id_col).isNull()).select(null.alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), null.alias("component_id"), F.lit(True).alias("kept"))
        return w.keep(out.unionByName(unnamed))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the one of each group of near duplicates that has the smallest doc_id; all
    columns stay, whatever their names. Null, empty and wordless texts stay, rows with a null
    doc_id too, and all rows of a doc_id that stays."""
    groups = near_dedup(docs, percent, words, id_col, text_col)
    [name] = fresh(docs, "near_gone")
    gone = groups.filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
