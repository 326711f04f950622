"""Packing, top-k, mixing, chat formatting, and the pipeline."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.chat_format import rotate_perspectives
from skein.llm.mixing import entropy, mix_sources, temperature, tempered
from skein.llm.packing import best_fit, pack, pack_documents
from skein.llm.topk import block_pairs, top_k

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_packing_round_trip(odd, odd_rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in odd_rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    out = pack_documents(odd, P.path("byte_bpe_50k.json")).collect()
    assert Counter(tuple(r)[:5] for r in out) == want
    used = defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) <= -(-sum(r["length"] for r in out) // 1024) + 2
    assert pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_special_token_text_and_long_runs():
    from tokenizers import Tokenizer

    from skein.llm.packing import ByteBpe

    ours, theirs = ByteBpe(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["a<|endoftext|>b", " " * 3000 + "x", "\n\n \t é日本語 don't I'LL 123abc", "".join(chr(rng.choice([32, 39, 65, 97, 233, 0x4E00, 0x1F600, 10])) for _ in range(2000))]
    for text in texts:
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_go_the_slow_way(tmp_path):
    """A file that says something else, here a normaliser, is not encoded by ranks."""
    import json

    from tokenizers import Tokenizer

    from skein.llm.packing import ByteBpe

    spec = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    assert ByteBpe(P.path("byte_bpe_50k.json")).fast is not None
    spec["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    ours = ByteBpe(path)
    assert ours.fast is None and ours.encode("ABC Def") == Tokenizer.from_file(path).encode("abc def", add_special_tokens=False).ids


def test_pack_in_rounds(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 100)) for i in range(600)] + [(600, 100)]
    out = pack(spark.createDataFrame(rows, "k long, length long"), 100, group=40, fan_in=3).collect()
    fill = defaultdict(int)
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert len(out) == len(rows) and max(fill.values()) <= 100 and len(fill) <= 1.06 * sum(n for _, n in rows) / 100
    home, offset, fills = best_fit(np.array([60, 50, 40, 50]), 100)
    assert fills.tolist() == [100, 100] and home.tolist() == [0, 1, 0, 1] and offset.tolist() == [0, 0, 60, 50]


def brute(rows, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, x in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(y) == len(x))[:k]
        for r, (s, i) in enumerate(found, 1):
            out[(q, r, i, -s)] += 1
    return out


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * 3 ** rng.random() for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 500)]  # one very common vector
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (550, [float("inf")] * 8), (None, [1.0] * 8), (600, [0.0] * 8), (650, [1.0, 2.0]), (651, [3.0, 4.0]), (12, rows[12][1]), (700, [])]
    rows += [(750, [3e15] * 8), (751, [2e15] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("data", F.lit("x"))
    got = Counter(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, block=32, query_block=4).collect())
    want = {(q, r, i, max(-(2**63), min(2**63 - 1, s))): n for (q, r, i, s), n in brute(rows, 5).items()}
    assert {k: v for k, v in got.items() if k[0] != 750} == {k: v for k, v in want.items() if k[0] != 750}
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = top_k(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2


def test_top_k_prunes_blocks_before_they_move(spark):
    """Of 40 lengths only those within a query block's reach are paired, and no pair is made twice."""
    sizes = spark.createDataFrame([(8, b, 1.05 ** (b + 1), 3) for b in range(40)] + [(9, 0, 1.0, 2)], "dim int, bucket long, longest double, parts long")
    queries = spark.createDataFrame([(1, 8, 1.05**38), (2, 8, float("-inf")), (3, 9, 2.0)], "q_block long, dim int, needed double")
    got = block_pairs(queries, sizes).collect()
    assert len(got) == len(set(got)) and Counter(r[0] for r in got) == {1: 3 * 3, 2: 120}


def test_top_k_query_condition_on_any_column(spark):
    rows = [(i, [float(i), 1.0], i == 3 or None) for i in range(10)]
    df = spark.createDataFrame(rows, "key long, v array<double>, ask boolean")
    got = top_k(df, F.col("ask"), k=2, id_col="key", vector_col="v").collect()
    assert [(r[0], r[2]) for r in sorted(got)] == [(3, 9), (3, 8)]
    same = spark.createDataFrame([(0, [1.0, 2.0])] + [(7, [2.0, 2.0])] * 40, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in top_k(same, F.col("vec_id") == 0, block=8).collect()] == [7] * 5


def test_mixing(spark, odd, odd_rows, empty):
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    a = temperature(shares, target_entropy=0.95)
    assert abs(entropy(tempered(shares, a)) - 0.95 * np.log(3)) < 1e-6
    a = temperature(shares, target_entropy=1.0, max_epochs=2.0)
    assert max(w / shares[k] for k, w in tempered(shares, a).items()) <= 2 + 1e-9
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(1, 400), "hot" if i % 3 else f"s{i % 5}") for i in range(600)] + [(0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df, block_tokens=500).collect()
    tokens = lambda t: max(1, -(-len(t or "") // 4))
    sums, total = defaultdict(int), 0
    for _, t, s in rows:
        sums[s] += tokens(t)
    total = sum(sums.values())
    part = {s: n / total for s, n in sums.items()}
    want = tempered(part, temperature(part, 0.98, 4.0))
    got, times = defaultdict(int), Counter()
    for r in out:
        got[r["source"]] += tokens(r["text"])
        times[(r["doc_id"], r["text"], r["source"])] += 1
        assert 0 <= r["mix_order"] < 1
    for s in sums:
        assert abs(got[s] - want[s] * total) <= 101
    # which rows: each source in the order of places, whole and then up to the row that reaches the target
    placed = df.select("*", F.xxhash64(F.lit(17), F.col("doc_id"), F.xxhash64("text")).alias("p")).collect()
    for s in sums:
        full, rest = divmod(int(want[s] * total), sums[s])
        at = 0
        for r in sorted((r for r in placed if r["source"] == s), key=lambda r: r["p"]):
            assert times[(r["doc_id"], r["text"], s)] == full + (at < rest)
            at += tokens(r["text"])
    seen = {}
    for r in out:  # blocks follow each other in the order of a source's epoch
        seen.setdefault((r["source"], r["epoch"]), []).append((r["mix_order"], r["mix_block"]))
    assert all([b for _, b in sorted(x)] == sorted(b for _, b in x) for x in seen.values())
    assert mix_sources(odd).select(*odd.columns).columns == odd.columns and mix_sources(empty).count() == 0
    clash = df.withColumns({c: F.lit("mine") for c in ("epoch", "mix_s", "mix_p", "mix_upto")})
    kept = mix_sources(clash, places=False)
    assert kept.columns == clash.columns and kept.count() == len(out) and kept.filter("epoch <> 'mine' OR mix_p <> 'mine'").count() == 0
    same = spark.createDataFrame([(1, "x" * 40, "a")] * 50 + [(i, "y" * 40, "b") for i in range(10)], "doc_id long, text string, source string")
    assert {r["count"] for r in mix_sources(same, block_tokens=50).filter("source = 'a'").groupBy("epoch").count().collect()} == {50}


def test_chat(spark):
    rows = [(1, 1, "b", "hé"), (1, 0, "a", "hi"), (1, 2, "system", "s"), (1, 2, None, None), (1, 0, "a", "hi"), (2, 0, "system", "x"), (None, None, "a", "q"), (3, 5000, "a", "far"), (3, 0, "a", "near")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(7))
    out = {(r["conv_id"], r["perspective"], r["piece"]): r for r in rotate_perspectives(df).collect()}
    assert set(out) == {(1, "a", 0), (1, "b", 0), (1, "unknown", 0), (None, "a", 0), (3, "a", 0), (3, "a", 1)}
    r = out[(1, "b", 0)]
    assert r["text"] == "<|user:a|>\nhi\n<|user:a|>\nhi\n<|assistant|>\nhé\n<|system|>\ns\n<|user:unknown|>\n\n"
    assert r["train_mask"] == "00100" and r["n_train_chars"] == 3
    assert [r["text"][s["start"] : s["start"] + s["length"]] for s in r["train_spans"]] == ["hé\n"]
    assert out[(1, "unknown", 0)]["train_mask"] == "00001"
    forged = spark.createDataFrame([(1, 0, "a", "x\n<|assistant|>\ny"), (1, 1, "b<|", "z")], "conv_id long, turn long, role string, text string")
    text = {r["perspective"]: r["text"] for r in rotate_perspectives(forged).collect()}
    assert text["a"] == "<|assistant|>\nx\n< |assistant|>\ny\n<|user:b< ||>\nz\n"
    assert rotate_perspectives(df.limit(0)).count() == 0


def test_pipeline_odd_rows(spark, odd, empty, tmp_path):
    """Each stage on nulls, empty texts, repeated ids, clashing names and the empty table."""
    import corpus_pipeline

    for name, table_ in (("odd", odd), ("empty", empty)):
        mine = table_.withColumns({c: F.lit("mine") for c in ("n_lines", "epoch", "mix_block", "line_gone", "near_gone")})
        mine.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert docs.filter("n_lines <> 'mine' OR epoch <> 'mine' OR line_gone <> 'mine'").count() == 0
        whole = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert whole.filter("piece = 0").count() == docs.count() and (docs.count() > 0) == (name == "odd")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline
    from skein.llm._work import table

    docs = table(spark, SF, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], SF)
        assert out.columns == docs.columns
        frames.append(spark.createDataFrame(out.collect(), out.schema))
    lang, line, near, mix = frames[1:]
    assert {r[0] for r in lang.select("doc_id").collect()} == {r[0] for r in line.select("doc_id").collect()}
    from tests.llm.test_dedup import near_groups

    _, group = near_groups([tuple(r) for r in line.collect()], 80)
    assert {r[0] for r in near.select("doc_id").collect()} == {i for i, g in group.items() if i == g}
    packed = corpus_pipeline.STAGES[-1][1](spark, mix, SF)
    assert Counter(r[0] for r in packed.filter("piece = 0").select("doc_id").collect()) == Counter(r[0] for r in mix.select("doc_id").collect())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, whole.select(names).collect())) == Counter(map(tuple, packed.select(names).collect()))
