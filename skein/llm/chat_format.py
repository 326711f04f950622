"""Chat formatting by perspective rotation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotate_perspectives(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", piece_turns: int = 4096) -> DataFrame:
    """For every participant the dialogue with that speaker as assistant and the others as
    named users: conv_id, perspective, piece, text, n_turns, train_mask, train_spans, n_train_chars.

    A turn is rendered as a header line `<|assistant|>`, `<|user:NAME|>` or `<|system|>`, its
    text and a newline. `<|` in names and texts becomes `< |`, so that no turn can forge a header.
    train_mask has a 1 for each turn of the perspective's speaker, else 0; train_spans has the
    (start, length) in characters of what is learned: text and newline of these turns. The system
    is no participant. Turns go by turn number (nulls first), ties by speaker and text; a turn
    that is there several times is rendered as often.

    A piece is what is rendered as one text: the turns of piece_turns turn numbers, 0 to 4095,
    4096 to 8191 and so on by default; spans count from its start. Dialogues of fewer turns are
    one piece, longer ones as many as they need, so that no dialogue is gathered in one task
    whatever its length. All of a dialogue's pieces, by number, are the dialogue. Null turn
    numbers are in piece 0.

    A null speaker is named `unknown`, a null text is empty, and null conv_ids are one dialogue.
    A dialogue of none but system turns has no participant and gives no row. Other columns are
    not read, whatever their names. An empty table gives no rows.
    """
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))
    said = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"))
    said = said.groupBy("conv_id", "turn", "speaker", "said").agg(F.count("*").cast("int").alias("times"))
    piece = F.coalesce(F.floor(F.col("turn") / piece_turns), F.lit(0)).alias("piece")
    # array_sort puts null turn numbers first in structs
    held = F.array_sort(F.collect_list(F.struct("turn", "speaker", "said", "times")))
    pieces = said.groupBy("conv_id", piece).agg(F.flatten(F.transform(held, lambda t: F.array_repeat(t, t["times"]))).alias("turns"))
    people = said.filter(F.col("speaker") != system).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    both = pieces.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))

    def part(t: Column) -> Column:
        own = t["speaker"] == F.col("perspective")
        user = F.when(t["speaker"] == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), safe(t["speaker"]), F.lit("|>\n")))
        return F.struct(F.when(own, F.lit("<|assistant|>\n")).otherwise(user).alias("head"), F.concat(safe(t["said"]), F.lit("\n")).alias("body"), own.alias("own"))

    parts = both.withColumn("parts", F.transform("turns", part))
    spans = (
        "aggregate(parts, named_struct('at', 0L, 'spans', cast(array() AS array<struct<start: bigint, length: bigint>>)), (s, p) -> named_struct("
        "'at', s.at + length(p.head) + length(p.body), 'spans', CASE WHEN p.own THEN array_append(s.spans, named_struct('start', s.at + length(p.head), 'length', cast(length(p.body) AS bigint))) ELSE s.spans END)).spans"
    )
    return parts.select(
        "conv_id",
        "perspective",
        "piece",
        F.expr("array_join(transform(parts, p -> concat(p.head, p.body)), '')").alias("text"),
        F.size("parts").cast("long").alias("n_turns"),
        F.expr("array_join(transform(parts, p -> if(p.own, '1', '0')), '')").alias("train_mask"),
        F.expr(spans).alias("train_spans"),
        F.expr("aggregate(parts, 0L, (s, p) -> s + if(p.own, length(p.body), 0))").alias("n_train_chars"),
    )
