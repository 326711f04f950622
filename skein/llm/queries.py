"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._work import Workspace, table
from skein.llm.chat_format import rotate_perspectives
from skein.llm.exact_dedup import exact_dedup
from skein.llm.language_id import fold, identify, train
from skein.llm.line_dedup import line_dedup
from skein.llm.mixing import mix_sources
from skein.llm.near_dedup import near_dedup
from skein.llm.packing import pack_documents
from skein.llm.quality import fit, score_quality, statistics
from skein.llm.suffix_dedup import remove_repeats
from skein.llm.topk import top_k


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), min_bytes=50).drop("text", "spans")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), digest.alias("kept_sha256"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "epoch", "mix_block", "mix_order")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("n_train_spans", F.size("train_spans").cast("long")).drop("train_spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = train(docs.filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    with Workspace(spark, "quality") as w:
        stats = w.keep(statistics(docs))
    known = stats.join(labels.select("doc_id", "quality").filter(~held_out), "doc_id")
    return score_quality(stats, fit(known)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer())


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_exact_dedup, op3_line_dedup, op4_mix_sources, op5_chat_format, op6_language_id, op7_quality, op8_near_dedup, op9_best_fit_packing, op10_top_k, pipeline)
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS u(i)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.first < w.doc_id),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM g),
r AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
parts AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE coalesce(head, '') || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)""",
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOW} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
    "op3_line_dedup": """
WITH d AS (SELECT doc_id, text IS NULL AS missing, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win FROM d, unnest(range(1, len(ls) - 1)) AS u(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1), (2)) AS o(k)),
ln AS (SELECT doc_id, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n_removed FROM ln LEFT JOIN gone AS g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN missing THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d JOIN kept USING (doc_id)""",
    "op5_chat_format": """
WITH s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS told, replace(coalesce(text, ''), '<|', '< |') AS said, coalesce(turn // 4096, 0) AS piece FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
r AS (
  SELECT s.conv_id, perspective, piece, turn, speaker, told, said, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>' ELSE '<|user:' || replace(speaker, '<|', '< |') || '|>' END || chr(10) || said || chr(10) AS part
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, perspective, piece, string_agg(part, '' ORDER BY turn NULLS FIRST, speaker, told) AS text, count(*) AS n_turns,
  string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, speaker, told) AS train_mask,
  CAST(coalesce(sum(length(said) + 1) FILTER (WHERE own), 0) AS BIGINT) AS n_train_chars, count(*) FILTER (WHERE own) AS n_train_spans
FROM r GROUP BY conv_id, perspective, piece""",
    "op8_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
edges AS (SELECT a, b FROM pairs JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach AS r JOIN edges AS e ON r.other = e.a),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)""",
    "op10_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
u AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM u AS q JOIN u AS c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
