"""Language identification by nearest centroids of TF-IDF vectors.

A text's vector counts its byte n-grams (of the lower-cased UTF-8, what is no letter being space), hashed to ``DIMS`` places: logarithm of the
count, times the inverse document frequency over all documents, normalised. Each language has several
centroids, found by spherical k-means over a bounded sample of labelled documents; a text gets the
language of the centroid with the largest cosine, unless it is farther from it than labelled texts of
that language and of its length are.

The model - centroids, frequencies and limits - is of a fixed size per language. Fitting a
language is one task; everything else is one pass each over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, steps

DIMS = 4096
GRAMS = (2, 3)
#: Labelled documents per language that centroids are fitted on, about: the bound of the sample.
SAMPLE = 1000
CENTROIDS = 4
#: Share of a language's labelled texts that its limits hold, and what is added to their distances.
HELD, SLACK = 0.999, 0.05
UNKNOWN = "und"
_LENGTHS = 32
#: Texts of one table of counts.
ROWS = 500


_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams: a row of DIMS places per text. Whatever is no letter counts as one space."""
    data = _LETTER[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = data[keep]
    n, texts = len(data), len(offsets) - 1
    out = np.zeros(texts * DIMS, np.int64)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    wide = data.astype(U64)
    for g in GRAMS:
        if n < g:
            continue
        code = np.full(n - g + 1, g, U64)
        for k in range(g):
            code = (code << U64(8)) | wide[k : n - g + 1 + k]
        with np.errstate(over="ignore"):
            place = (mix(code) & U64(DIMS - 1)).astype(np.int64)
        inside = owner[: n - g + 1] == owner[g - 1 :]
        out += np.bincount((owner[: n - g + 1] * DIMS + place)[inside], minlength=texts * DIMS)
    return out.reshape(texts, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows for ``gram_counts``, whose table is bounded whatever the size of a batch."""
    for s in range(0, len(column), ROWS):
        for i, j, data, offsets in steps(column[s : s + ROWS], 1_000_000):
            yield s + i, s + j, data, offsets


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(_LENGTHS - 1, np.log2(1 + counts.sum(axis=1)).astype(np.int64))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for i, j, data, offsets in _parts(batch.column("text")):
            total += (gram_counts(data, offsets) > 0).sum(axis=0)
            texts += j - i
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMS), -1)), pa.array(np.append(total, texts))], ["_place", "_n"])


def centroids(x: np.ndarray, k: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: ``k`` unit vectors, or fewer if ``x`` has fewer rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    chosen = [int(rng.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    while len(chosen) < k:
        p = np.maximum(far, 0).astype(np.float64) ** 2
        chosen.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for m in range(k):
            mine = x[near == m]
            if len(mine):
                total = mine.sum(axis=0)
                c[m] = total / max(np.linalg.norm(total), 1e-12)
    return c


def limits(similarity: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Least cosine by length: that of labelled texts of the length or the next longer ones."""
    out = np.full(_LENGTHS, 1.0)
    for b in range(_LENGTHS - 1, -1, -1):
        mine = similarity[bucket == b]
        if b + 1 < _LENGTHS:
            out[b] = out[b + 1]
        if len(mine):
            out[b] = min(out[b], float(np.quantile(mine, 1 - HELD)) - SLACK)
    # Lengths beyond those seen are held to the longest seen; below them nothing is rejected.
    seen = np.unique(bucket)
    out[seen.max() + 1 :] = out[seen.max()]
    out[: seen.min()] = -1.0
    return out


def _fit(rows: pd.DataFrame, idf: np.ndarray, k: int) -> pd.DataFrame:
    rows = rows.sort_values(["_hash", "_text"])
    data = [t.encode() for t in rows["_text"]]
    parts, buckets = [], []
    for s in range(0, len(data), 200):
        block = data[s : s + 200]
        c = gram_counts(np.frombuffer(b"".join(block), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in block])]))
        parts.append(vectors(c, idf))
        buckets.append(_bucket(c))
    x, bucket = np.concatenate(parts), np.concatenate(buckets)
    c = centroids(x, k)
    least = limits((x @ c.T).max(axis=1), bucket)
    return pd.DataFrame({"_lang": rows["_lang"].iloc[0], "_centroid": [r.tolist() for r in c], "_least": [least.tolist()] * len(c)})


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], matrix: np.ndarray, least: np.ndarray) -> None:
        self.idf, self.names, self.matrix, self.least = idf, names, matrix, least

    def classify(self, batches: Iterator[pa.RecordBatch], known: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _parts(batch.column("_text")):
                counts = gram_counts(data, offsets)
                if len(self.names):
                    like = vectors(counts, self.idf) @ self.matrix.T
                    best = like.argmax(axis=1)
                    top = like[np.arange(j - i), best].astype(np.float64)
                    ok = (top >= self.least[best, _bucket(counts)]) & (counts.sum(axis=1) > 0)
                    name = [self.names[b] if good else UNKNOWN for b, good in zip(best.tolist(), ok.tolist())]
                else:
                    top, name = np.zeros(j - i), [UNKNOWN] * (j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(name, pa.string()), pa.array(np.where(counts.sum(axis=1) > 0, 1 - top, 1.0))], known
                )


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """The model of the languages that the ``lang`` of ``docs`` names."""
    low = docs.select(F.lower("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = low.where("text is not null").select("text").mapInArrow(_frequencies, "_place long, _n long").groupBy("_place").agg(F.sum("_n").alias("_n")).collect()
    df, texts = np.zeros(DIMS), 0
    for r in found:
        if r._place < 0:
            texts = r._n
        else:
            df[r._place] = r._n
    idf = (np.log((1 + texts) / (1 + df)) + 1).astype(np.float32)
    labelled = low.where("lang is not null and length(text) > 1")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(idf, [], np.zeros((0, DIMS), np.float32), np.zeros((0, _LENGTHS)))
    # The share of hashes that gives about ``sample`` documents of each language: no sort, no shuffle of the rest.
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / n))])
    part = labelled.withColumn("_hash", F.xxhash64("text")).where(F.pmod(F.col("_hash"), F.lit(1_000_003)) < F.try_element_at(share, F.col("lang")) * 1_000_003)
    # A text counts once, however often it occurs: the sample's size has a bound.
    part = part.select(F.col("lang").alias("_lang"), F.col("text").alias("_text"), "_hash").dropDuplicates(["_lang", "_text"])
    fitted = part.groupBy("_lang").applyInPandas(lambda rows: _fit(rows, idf, k), "_lang string, _centroid array<float>, _least array<double>")
    rows = sorted(fitted.collect(), key=lambda r: (r._lang, r._centroid))
    if not rows:
        return Model(idf, [], np.zeros((0, DIMS), np.float32), np.zeros((0, _LENGTHS)))
    return Model(idf, [r._lang for r in rows], np.array([r._centroid for r in rows], np.float32), np.array([r._least for r in rows]))


def identify(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> DataFrame:
    """(doc_id, language, distance) of every document: the language, or "und", and the cosine distance.

    Centroids are fitted on about ``sample`` documents per value of ``lang``; with fewer documents of a
    language, on all of them. Document frequencies are those of all documents.

    Defined cases: null and empty texts and texts without two letters together are "und" at distance 1; rows with a null
    ``lang`` are classified but not learnt from; if no row has one, all are "und"; ``doc_id`` may be
    null or repeat, each row is classified on its own; of equally near centroids that of the first
    language by name wins; long texts are counted whole; further columns are not read; an empty table gives an empty one.
    """
    model = fit(docs, sample, k)
    plain = docs.select("doc_id", F.lower("text").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(lambda it: model.classify(it, ["doc_id", "language", "distance"]), f"doc_id {kind}, language string, distance double")
