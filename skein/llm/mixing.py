"""Mixing sources to target weights: temperature, repetition limit, budgeted permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm._work import Workspace, fresh

#: More sources than this are no mixture; their totals would not fit the driver.
MAX_SOURCES = 100_000


def tempered(shares: dict, exponent: float) -> dict:
    """Normalised shares ** exponent."""
    powered = {k: p**exponent for k, p in shares.items()}
    total = math.fsum(powered.values())
    return {k: x / total for k, x in powered.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(x * math.log(x) for x in weights.values() if x > 0)


def temperature(shares: dict, target_entropy: float | None = None, max_epochs: float | None = None, budget_share: float = 1.0, steps: int = 60) -> float:
    """The largest exponent in [0, 1] whose weights have at least target_entropy (a share of the
    largest possible), and then the smallest one from it up to 1 that keeps every source within
    max_epochs repetitions of a budget of budget_share times all tokens. Both are bisected:
    entropy falls and the most repeated source is repeated less as the exponent rises."""

    def bisect(ok, low: float, high: float) -> tuple[float, float]:
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low, high

    def epochs(a: float) -> float:
        return max(x * budget_share / shares[k] for k, x in tempered(shares, a).items())

    at = 1.0
    if target_entropy is not None and len(shares) > 1 and entropy(shares) < (goal := target_entropy * math.log(len(shares))):
        at = bisect(lambda a: entropy(tempered(shares, a)) >= goal, 0.0, 1.0)[0]
    if max_epochs is not None and epochs(at) > max_epochs:
        at = bisect(lambda a: epochs(a) > max_epochs, at, 1.0)[1]
    return at


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", target_entropy: float | None = 0.98, max_epochs: float | None = 4.0, budget_share: float = 1.0, block_tokens: int = 1 << 22, seed: int = 17, places: bool = True) -> DataFrame:
    """The rows of a mixture: all columns of docs and epoch, mix_block, mix_order; not these three
    without places.

    A text's tokens are estimated as a quarter of its UTF-8 bytes, one at least. A source's
    share of all tokens is raised to the exponent that temperature() finds; its weight times
    the budget (budget_share of all tokens) is its target. Each source is a pseudo-random
    permutation of its rows in blocks; it is given whole as often as its target holds it, then
    once more as far as the row with which the target is reached. So a row appears once for
    each epoch that takes it, in no epoch where its source is cut. mix_order in [0, 1) spreads
    every source evenly over the mixture: sorted by it, any stretch has about the weights.

    A null source is a source of its own. Null and empty texts have one token. Repeated rows
    count as often as they appear; rows of equal doc_id and text have one place and are taken
    together. With places, columns of docs named as the new ones are replaced; no other name
    clashes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("epoch", "mix_block", "mix_order") if places else docs
    # names that no column of docs has
    S, T, P, B, N, BLOCKS, TARGET, EPOCH = fresh(docs, "mix_s", "mix_t", "mix_p", "mix_b", "mix_n", "mix_blocks", "mix_target", "mix_epoch")
    tokens = F.greatest(F.ceil(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) / 4), F.lit(1)).cast("long")
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col))
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    keyed = docs.select("*", source.alias(S), tokens.alias(T), place.alias(P))
    share = F.col(P).cast("double") / F.lit(2.0**64) + 0.5  # how far a place is through its source
    with Workspace(spark, "mixing") as w:
        # the permutation goes by place; a source's blocks are ranges of it
        sums = {r[0]: r[1] for r in keyed.groupBy(S).agg(F.sum(T)).limit(MAX_SOURCES + 1).collect()}
        if len(sums) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        total = sum(sums.values())
        if not total:
            none = {"epoch": F.lit(0).cast("long"), "mix_block": F.lit(0).cast("long"), "mix_order": F.lit(0.0)}
            return docs.withColumns(none) if places else docs
        shares = {k: n / total for k, n in sums.items()}
        weights = tempered(shares, temperature(shares, target_entropy, max_epochs, budget_share))
        plan = [(k, n, max(1, -(-n // block_tokens)), int(weights[k] * budget_share * total)) for k, n in sorted(sums.items())]
        plan = F.broadcast(spark.createDataFrame(plan, f"{S} string, {N} long, {BLOCKS} long, {TARGET} long"))  # MAX_SOURCES rows at most
        rows = keyed.join(plan, S).withColumn(B, F.floor(share * F.col(BLOCKS)).cast("long"))
        # what follows reads these alone, no text
        narrow = w.stage(rows.select(*(F.col(c).alias(d) for c, d in ((S, "s"), (B, "b"), (P, "p"), (T, "t"), (N, "n"), (TARGET, "target"), (BLOCKS, "blocks")))))
        blocks = w.stage(narrow.groupBy("s", "b").agg(F.sum("t").alias("t"), F.first("n").alias("n"), F.first("target").alias("target")))
        # a block's place in its source: sums over groups of blocks first, so that no window holds all of a large source's blocks
        blocks = blocks.withColumn("g", F.floor(F.col("b") / 4096))
        groups = blocks.groupBy("s", "g").agg(F.sum("t").alias("gt"))
        groups = groups.select("s", "g", (F.sum("gt").over(W.partitionBy("s").orderBy("g")) - F.col("gt")).alias("g0"))
        within = F.sum("t").over(W.partitionBy("s", "g").orderBy("b")) - F.col("t")
        blocks = blocks.withColumn("b0", within).join(groups, ["s", "g"]).withColumn("b0", F.col("b0") + F.col("g0"))
        full, rest = F.expr("target div n"), F.expr("target % n")
        state = F.when(rest >= F.col("b0") + F.col("t"), 1).when(rest <= F.col("b0"), 0).otherwise(2)
        blocks = w.stage(blocks.select("s", "b", "b0", full.alias("full"), rest.alias("rest"), state.alias("state")))
        # one block of a source at most is cut: first between its 256 parts, and only one part's places are ordered
        cut = narrow.join(F.broadcast(blocks.filter("state = 2").select("s", "b", "b0", "rest")), ["s", "b"])  # a row for each source at most
        cut = cut.withColumn("part", F.floor(((F.col("p").cast("double") / F.lit(2.0**64) + 0.5) * F.col("blocks") - F.col("b")) * 256))
        parts = cut.groupBy("s", "b", "part").agg(F.sum("t").alias("t"), F.first("b0").alias("b0"), F.first("rest").alias("rest"))
        parts = parts.withColumn("p0", F.col("b0") + F.sum("t").over(W.partitionBy("s").orderBy("part")) - F.col("t"))
        last = w.stage(parts.filter("p0 < rest").groupBy("s").agg(F.max("part").alias("part"), F.max("p0").alias("p0")))
        cut = cut.join(F.broadcast(last), ["s", "part"])  # a row for each source at most
        cut = cut.groupBy("s", "p").agg(F.sum("t").alias("t"), F.first("p0").alias("p0"), F.first("rest").alias("rest"))
        at = F.col("p0") + F.sum("t").over(W.partitionBy("s").orderBy("p")) - F.col("t")
        edge = cut.withColumn("at", at).filter("at < rest").groupBy("s").agg(F.max("p").alias("edge"))
        # blocks lie in the order of places, so a source's rows are taken up to its edge, else by its last whole block
        whole = blocks.groupBy("s").agg(F.max(F.when(F.col("state") == 1, F.col("b"))).alias("upto"), F.first("full").alias("full"))
        ENDS = fresh(rows, "mix_upto", "mix_full", "mix_edge")
        ends = w.keep(whole.join(edge, "s", "left").select(F.col("s").alias(S), *(F.col(c).alias(e) for c, e in zip(("upto", "full", "edge"), ENDS))))
    rows = rows.join(F.broadcast(ends), S)  # a row for each source
    upto, full, edge = (F.col(c) for c in ENDS)
    extra = F.coalesce(F.col(B) <= upto, F.lit(False)) | F.coalesce(F.col(P) <= edge, F.lit(False))
    times = full + F.when(extra, 1).otherwise(0)
    rows = rows.filter(times > 0).withColumn(EPOCH, F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    order = F.least((F.col(EPOCH) + share) * F.col(N) / F.greatest(F.col(TARGET), F.lit(1)), F.lit(1 - 2**-53))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*kept, F.col(EPOCH).alias("epoch"), F.col(B).alias("mix_block"), order.alias("mix_order")) if places else rows.select(kept)
