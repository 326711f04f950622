"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm._text import U64, chunks, mix

UNKNOWN = "und"
MAX_LANGUAGES = 10_000
_SCHEMA = "doc_id long, lang_pred string, score double"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point: whether it is a letter. Built once in a worker."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """The random +1/-1 vector of each letter, its bits hashed from code point and place; code 0 is
    the gap between words."""
    words = np.arange(-(-dim // 64), dtype=U64)
    bits = mix(mix(codes.astype(U64) + U64(dim << 32))[:, None] + words * U64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :dim].astype(np.int8) * 2 - 1


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter trigrams of lower-cased texts, runs of anything else being one gap: the code
    points (a, b, c) of each different trigram, and, in the order of texts, (text, trigram, how
    often) of those that a text has. No table of texts by trigrams is made, as short texts of
    large alphabets have nearly as many trigrams as letters."""
    joined = "\0\0".join(texts).lower()
    lengths = [len(t.lower()) for t in texts]
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.array(lengths) + 2)[: len(codes)]
    # two gaps stand between texts; of a run of gaps in a text one stays
    gap = codes == 0
    stay = ~gap
    stay[1:] |= ~gap[:-1]
    stay[:1] = True
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    stay[first] = True
    codes, owner = codes[stay], owner[stay]
    codes, owner = np.append(codes, [0, 0]), np.append(owner, [len(texts)] * 2)
    alphabet, small = np.unique(codes, return_inverse=True)
    n = len(alphabet)
    trigram = (small[:-2] * n + small[1:-1]) * n + small[2:]
    good = (owner[:-2] == owner[1:-1]) & (codes[1:-1] > 0)
    trigram, owner = trigram[good], owner[:-2][good]
    if n**3 < 1 << 24:
        there = np.zeros(n**3, bool)
        there[trigram] = True
        kinds = np.flatnonzero(there)
        place = np.zeros(n**3, np.int64)
        place[kinds] = np.arange(len(kinds))
        place = place[trigram]
    else:
        kinds, place = np.unique(trigram, return_inverse=True)
    abc = alphabet[np.stack([kinds // (n * n), kinds // n % n, kinds % n])]
    each = owner * max(1, len(kinds)) + place
    if len(texts) * len(kinds) < 1 << 24:
        count = np.bincount(each)
        each = np.flatnonzero(count)
        count = count[each]
    else:
        each, count = np.unique(each, return_counts=True)
    return abc, each // max(1, len(kinds)), each % max(1, len(kinds)), count.astype(np.float32)


def _bundled(abc: np.ndarray, row: np.ndarray, kind: np.ndarray, weight: np.ndarray, rows: int, dim: int, block: int = 1 << 13) -> np.ndarray:
    """For each row the weighted sum of its trigrams' vectors. Trigram vectors are made `block` at
    a time and summed block by block: small tables by a matrix product, sparse ones by entries."""
    out = np.zeros((rows, dim), np.float32)
    order = np.argsort(kind, kind="stable")
    row, kind, weight = row[order], kind[order], weight[order]
    edges = np.searchsorted(kind, np.arange(0, abc.shape[1] + block, block))
    at, turned = _letter_tables(abc, dim)
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        # a trigram's vector: its letters' turned vectors, multiplied
        x, y, z = (t[p] for t, p in zip(turned, at[:, k * block : (k + 1) * block]))
        vectors = (x * y * z).astype(np.float32)
        r, c, w = row[a:b], kind[a:b] - k * block, weight[a:b]
        there, r = np.unique(r, return_inverse=True)
        if len(there) * len(vectors) <= min(64 * len(r), 1 << 24):
            table = np.zeros((len(there), len(vectors)), np.float32)
            table[r, c] = w
            out[there] += table @ vectors
            continue
        order = np.argsort(r, kind="stable")
        r, c, w = r[order], c[order], w[order]
        for s in range(0, len(r), block):
            part = vectors[c[s : s + block]]
            part *= w[s : s + block, None]
            of, first = np.unique(r[s : s + block], return_index=True)
            out[there[of]] += np.add.reduceat(part, first, axis=0)
    return out


def _letter_tables(abc: np.ndarray, dim: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The trigrams in numbers of an alphabet, and its letters' vectors turned by 2, 1 and 0 places."""
    alphabet, at = np.unique(abc, return_inverse=True)
    vectors = letter_vectors(alphabet, dim)
    return at.reshape(abc.shape), [np.roll(vectors, 2, 1), np.roll(vectors, 1, 1), vectors]


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


@dataclass(frozen=True)
class LanguageModel:
    """One prototype of unit length for each language, languages in order."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    dim: int

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        abc, row, kind, count = _grams(texts)
        if not len(self.languages) or not count.size:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        documents = _bundled(abc, row, kind, count, len(texts), self.dim)
        norms = np.sqrt(np.einsum("ij,ij->i", documents, documents))
        cosines = documents @ self.prototypes.T / np.maximum(norms, 1e-9)[:, None]
        best = cosines.argmax(1)
        empty = np.bincount(row, minlength=len(texts)) == 0
        score = np.where(empty, 0, np.clip(cosines[np.arange(len(texts)), best], 0, 1)).astype(float)
        return [UNKNOWN if e else self.languages[b] for e, b in zip(empty, best)], score


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = 512) -> LanguageModel:
    """Bundles all texts with a non-null language. Each text weighs the same: its trigram
    frequencies add up to 1. Tasks send one vector a language and slice of rows, which are
    summed by language before the driver reads them."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, _, _ in chunks(batches, text_col, 2 << 20):
            abc, row, kind, count = _grams(_texts(rows, text_col))
            if not count.size:
                continue
            count /= np.bincount(row, weights=count)[row]
            names, lang = np.unique(rows.column(lang_col).to_pylist(), return_inverse=True)
            each, of = np.unique(lang[row] * abc.shape[1] + kind, return_inverse=True)
            vectors = _bundled(abc, each // abc.shape[1], each % abc.shape[1], np.bincount(of, weights=count).astype(np.float32), len(names), dim)
            for k, v in zip(names.tolist(), vectors):
                sums[k] = sums.get(k, 0) + v.astype(float)
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * dim, pa.string()), "place": pa.array(range(dim), pa.int32()), "x": v})

    known = docs.select(text_col, lang_col).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = known.mapInArrow(bundle, "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x"))
    found = sums.limit(MAX_LANGUAGES * dim + 1).toPandas()
    if len(found) > MAX_LANGUAGES * dim:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not len(found):
        return LanguageModel((), np.zeros((0, dim), np.float32), dim)
    wide = found.pivot(index="lang", columns="place", values="x").sort_index()
    profiles = wide.to_numpy()
    norms = np.sqrt((profiles**2).sum(1, keepdims=True))
    return LanguageModel(tuple(wide.index), (profiles / np.maximum(norms, 1e-9)).astype(np.float32), dim)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the language whose prototype has the largest
    cosine with the text's vector, ties to the first in order, and that cosine cut to [0, 1].
    Null texts and those without a letter are `und` with score 0, as are all if the model knows
    no language. Repeated rows give repeated rows; no other column is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in chunks(batches, text_col, 2 << 20):
            names, score = model.predict(_texts(rows, text_col))
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, _SCHEMA)


def filter_languages(docs: DataFrame, model: LanguageModel, min_score: float | None = None, min_bytes: int = 100, text_col: str = "text") -> DataFrame:
    """docs without the rows that language identification rejects: those that are `und`, and
    those of min_bytes or more whose score is below min_score, which are like no language
    learned; shorter texts' scores say too little. By default that is four standard deviations
    of the cosine of unrelated vectors, 4 / sqrt(dim). All columns stay."""
    least = 4 / model.dim**0.5 if min_score is None else min_score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, offsets in chunks(batches, text_col, 2 << 20):
            names, score = model.predict(_texts(rows, text_col))
            good = [n != UNKNOWN and (s >= least or size < min_bytes) for n, s, size in zip(names, score, np.diff(offsets))]
            yield rows.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
