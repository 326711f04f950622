"""Language ID and quality: held-out accuracy, and defined results for odd rows."""

import os
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import queries
from skein.llm._work import table
from skein.llm.language_id import LanguageModel, filter_languages, fold, identify, letter_vectors, train
from skein.llm.quality import FEATURES, features, fit, score_quality, statistics

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_language_held_out(spark):
    out = queries.op6_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and r[1] >= 0 and r[2] <= 1


@needs_data
def test_language_model_ignores_held_out_labels(spark):
    docs = table(spark, SF, "documents")
    model = train(docs.filter(fold("doc_id", 5) != 0))
    changed = docs.withColumn("lang", F.when(fold("doc_id", 5) == 0, F.lit("xx")).otherwise(F.col("lang")))
    again = train(changed.filter(fold("doc_id", 5) != 0))
    assert again.languages == model.languages and abs(again.prototypes - model.prototypes).max() < 1e-4


def test_language_odd(spark, odd, empty):
    model = train(odd)
    out = {(r["doc_id"]): r for r in identify(odd, model).collect()}
    for i in (0, 1, 2, 7):  # null, empty, blank, digits
        assert out[i]["lang_pred"] == "und" and out[i]["score"] == 0
    assert out[6]["lang_pred"] in ("en", "de") and identify(odd, model).count() == odd.count()
    assert identify(empty, model).count() == 0
    none = train(empty)
    assert {r["lang_pred"] for r in identify(odd, none).collect()} == {"und"}
    kept = filter_languages(odd, model)
    assert kept.columns == odd.columns
    assert not {0, 1, 2, 7} & {r["doc_id"] for r in kept.collect()}
    assert kept.count() == odd.count() - 4


def bundle(text, dim):
    """A text's vector by the definition, one trigram after another."""
    letters, gap = [], False
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
            gap = False
        elif not gap:
            letters.append(0)
            gap = True
    letters += [0] if letters and letters[-1] else []
    total, n = np.zeros(dim), 0
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b:
            x, y, z = letter_vectors(np.array([a, b, c]), dim).astype(float)
            total += np.roll(x, 2) * np.roll(y, 1) * z
            n += 1
    return total, n


def test_language_brute_force(spark, odd, odd_rows):
    """Prototypes, cosines and predictions of every row against a loop over trigrams."""
    model, dim = train(odd), 512
    sums = {}
    for r in odd_rows:
        if r[1] is not None and r[2] is not None and (found := bundle(r[1], dim))[1]:
            sums[r[2]] = sums.get(r[2], 0) + found[0] / found[1]
    assert model.languages == tuple(sorted(sums))
    want = np.stack([sums[k] / np.linalg.norm(sums[k]) for k in model.languages])
    assert np.abs(model.prototypes - want).max() < 1e-4
    got = {r["doc_id"]: r for r in identify(odd, model).collect() if r["doc_id"] is not None}
    for r in odd_rows:
        v, n = bundle(r[1] or "", dim)
        if n and r[0] is not None:
            cosines = want @ v / np.linalg.norm(v)
            assert abs(got[r[0]]["score"] - np.clip(cosines.max(), 0, 1)) < 1e-4
            assert cosines[model.languages.index(got[r[0]]["lang_pred"])] > cosines.max() - 1e-4


def test_language_large_alphabets():
    """Short texts of thousands of letters, and a very long one, in bounded memory."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 70))) for _ in range(3000)] + ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 300_000)))]
    prototypes = rng.standard_normal((2, 512)).astype(np.float32)
    model = LanguageModel(("a", "b"), prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True), 512)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    names, score = model.predict(texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    for i in (0, 2999):
        v, _ = bundle(texts[i], 512)
        assert abs(score[i] - max(0, (model.prototypes @ v / np.linalg.norm(v)).max())) < 1e-4


def test_language_filter_rejects_the_unlike(spark):
    import random

    rng = random.Random(1)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, " ".join(rng.choice("one two three house water over under the and of".split()) for _ in range(40)), "en") for i in range(40)]
    rows += [(100 + i, make("αβγδεζηθικλμνξοπρστυφχψω", 40), None) for i in range(20)] + [(200 + i, make("bcdfghjklmnpqrstvwxz", 40), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r[0] for r in filter_languages(docs, train(docs)).select("doc_id").collect()) == list(range(40))


def test_quality_brute_force(spark, odd, odd_rows):
    """Scores against a plain discriminant over the same statistics."""
    stats = statistics(odd)
    model = fit(stats.withColumn("quality", (F.col("doc_id") % 2).cast("int")))
    texts = [(r[0], r[1] or "") for r in odd_rows]
    x = {t: features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in texts}
    part = [np.stack([x[t] for i, t in texts if i is not None and i % 2 == k]) for k in (0, 1)]
    n = [len(p) for p in part]
    spread = [np.cov(p.T, bias=True) for p in part]
    pooled = np.diag((spread[0] * n[0] + spread[1] * n[1]) / sum(n)) + 1e-6
    shrunk = [0.9 * s + 0.1 * np.diag(pooled) + 1e-6 * np.eye(len(pooled)) for s in spread]

    def density(k, v):
        d = v - part[k].mean(0)
        return -0.5 * (d @ np.linalg.solve(shrunk[k], d) + np.linalg.slogdet(shrunk[k])[1])

    got = {r["doc_id"]: r for r in score_quality(stats, model).collect() if r["doc_id"] is not None}
    prior = (n[1] + 1) / (sum(n) + 2)
    for i, t in texts:
        if i is not None:
            odds = (density(1, x[t]) - density(0, x[t])) / model.temper + np.log(prior / (1 - prior))
            assert abs(got[i]["score"] - 1 / (1 + np.exp(-np.clip(odds, -60, 60)))) < 1e-6


def test_quality_statistics():
    """Counts of one text by hand: bytes, words, capitals, digits, repeated words."""
    text = "Aa Aa b1! |\n\u00e9\u00e9"
    data = np.frombuffer(text.encode(), np.uint8)
    got = dict(zip(FEATURES, features(data, np.array([0, len(data)]))[0]))
    size = len(data)
    logit = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    want = {"bytes": np.log1p(size), "words": np.log1p(5), "upper": logit(2, size), "digits": logit(1, size), "emphasis": logit(1, size), "markup": logit(1, size), "other": logit(4, size), "breaks": logit(1, size), "same_as_before": logit(1, 5)}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


@needs_data
def test_quality_held_out(spark):
    out = queries.op7_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_quality_odd(spark, odd, empty):
    stats = statistics(odd)
    rows = stats.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    model = fit(rows)
    out = score_quality(stats, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert model.means.shape == (2, len(FEATURES))
    assert score_quality(statistics(empty), model).count() == 0
    one_class = fit(rows.withColumn("quality", F.lit(1)))
    assert len({r["score"] for r in score_quality(stats, one_class).collect()}) == 1
    assert fit(statistics(empty).withColumn("quality", F.lit(1))).prior == 0.5
