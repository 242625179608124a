"""Quality rules: robust multivariate outliers by minimum covariance determinants.

Each document gives counts (letters, capitals, digits, ...) over its whole text; their ratios, drawn
towards the ratio of the document's group where a text is short and put through the arcsine
of the square root, make its vector. A group is a language and source. Its centre and covariance are those
of the ``share`` of its documents that lie closest, found by concentration steps (Rousseeuw and Van
Driessen, 1999) from a deterministic robust start, the medians and median absolute deviations (as
Hubert, Rousseeuw and Verdonck, 2012). Documents beyond a limit of the Mahalanobis
distance go. Digits and symbols count as what is no letter: most documents have none of either, so ratios of their
own would vary in nothing among the closest documents, and any digit would be infinitely far.

A concentration step over any number of rows is one aggregation: moments are summed per group and
narrow range of distance, and the ranges up to the wanted share are then added up, so no group is
collected, sampled or sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Words, cut, lists, steps, unused

#: Counts of a text, and the ratios of its vector as (of, among),
COUNTS = ["words", "chars", "letters", "capitals", "varied"]
RATIOS = [("capitals", "letters"), ("letters", "chars"), ("varied", "words"), ("words", "chars")]
#: Added to each variance, so that a group of equal vectors has an inverse; other groups' variances are far larger.
RIDGE = 1e-6
P = len(RATIOS)
#: Words of a stretch within which varied words are counted, so that long texts don't seem repetitive.
STRETCH = 50

SHARE = 0.75
STEPS = 6
#: Documents of a smaller group are judged among all of their language, or of the table.
LEAST_GROUP = 25
#: Characters, letters or words by which a ratio is drawn towards its group's.
PRIOR = {"chars": 100.0, "letters": 100.0, "words": 20.0}
#: Standard deviations beyond which a document goes. Vectors of clean documents have longer tails than a normal distribution:
#: one in a hundred lies beyond ten, for an address or a number in a short text, and junk lies beyond seventeen.
LIMIT = 16.0
#: Groups up to which estimates are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000
_RANGES = 32

_KIND = np.zeros(256, np.int8)  # 0 other, 1 letter, 2 capital
for _b in range(33, 127):
    _KIND[_b] = 2 if chr(_b).isupper() else 1 if chr(_b).isalpha() else 0


def counts(text: pa.Array) -> pa.Array:
    """COUNTS of each text. Capitals beyond ASCII are those of Latin-1; a null text counts as empty."""
    hasher, out = Hasher(), []
    for i, j, data, offsets in steps(text):
        words = Words(data, offsets)
        n = len(data)
        kind = _KIND[data]
        table = np.zeros((j - i, len(COUNTS)))

        def per_text(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[offsets])

        begins = (data & 0xC0) != 0x80
        space = (data == 32) | ((data >= 9) & (data <= 13))
        wide = (data >= 0xC0)
        capital = kind == 2
        if n > 1:
            capital[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        table[:, 0] = words.counts
        table[:, 1] = per_text(begins & ~space)
        table[:, 2] = per_text((kind == 1) | (kind == 2) | wide)
        table[:, 3] = per_text(capital)
        hashes = hasher.spans(data, words.start, words.end)
        owner = words.owner()
        stretch = (np.arange(len(owner)) - words.first[owner]) // STRETCH
        if len(owner):
            new = np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (owner[1:] != owner[:-1])])
            number = np.cumsum(new) - 1
            # Forty bits of a hash among at most fifty words: they are as good as the words.
            key = np.sort((number.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
            once = key[np.concatenate([[True], key[1:] != key[:-1]])]
            varied = np.bincount((once >> np.uint64(40)).astype(np.int64), minlength=number[-1] + 1)
            table[:, 4] = np.bincount(owner[new], weights=varied, minlength=j - i)
        out.append(table)
    flat = np.concatenate(out) if out else np.zeros((0, len(COUNTS)))
    return lists(flat.reshape(-1), np.arange(len(flat) + 1) * len(COUNTS))


def chi2(x: float, df: int) -> float:
    """Distribution function of chi square for even degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, df // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi2_point(q: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2(mid, df) < q else (lo, mid)
    return hi


def _strata(stats: DataFrame, least: int) -> DataFrame:
    """(_lang, _source, _group, _pools): the group that each language and source is judged in, and all that it is estimated in.

    Small ones are judged among all documents of their language, or of the whole table if these are few
    too; in a smaller table the group is null and rejects nobody.
    """
    here = stats.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    per_lang = here.groupBy("_lang").agg(F.sum("_n").alias("_ln"), F.min("_n").alias("_few"))
    whole = per_lang.agg(F.sum("_ln").alias("_on"), F.min("_ln").alias("_short"))
    here = here.join(per_lang, "_lang").crossJoin(whole)
    level = F.when(F.col("_n") >= least, 0).when(F.col("_ln") >= least, 1).when(F.col("_on") >= least, 2)
    names = [F.concat_ws("\u0001", F.lit(str(k)), *[F.col(c) for c in ("_lang", "_source")[: 2 - k]]) for k in range(3)]
    used = [F.col("_n") >= least, (F.col("_ln") >= least) & (F.col("_few") < least), (F.col("_on") >= least) & (F.col("_short") < least)]
    return here.select(
        "_lang", "_source", F.when(level == 0, names[0]).when(level == 1, names[1]).when(level == 2, names[2]).alias("_group"),
        F.array_compact(F.array(*[F.when(u, x) for u, x in zip(used, names)])).alias("_pools"),
    )


def _vector(counted: Column, base: Column) -> list[Column]:
    at = {c: i for i, c in enumerate(COUNTS)}
    out = []
    for k, (of, among) in enumerate(RATIOS):
        prior = F.lit(PRIOR[among])
        ratio = (F.get(counted, F.lit(at[of])) + prior * F.get(base, F.lit(k))) / (F.get(counted, F.lit(at[among])) + prior)
        out.append(F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))))
    return out


def _distance(y: list[Column], centre: Column, scale: Column) -> Column:
    """Squared Mahalanobis distance; ``scale`` is the flattened inverse of the covariance's Cholesky factor."""
    d = [c - F.get(centre, F.lit(k)) for k, c in enumerate(y)]
    total = None
    for r in range(P):
        z = None
        for c in range(r + 1):
            term = F.get(scale, F.lit(r * P + c)) * d[c]
            z = term if z is None else z + term
        total = z * z if total is None else total + z * z
    return total


def _scale(cov: np.ndarray) -> list[float]:
    return np.linalg.inv(np.linalg.cholesky(cov + RIDGE * np.eye(P))).reshape(-1).tolist()


def _start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        centre = [np.asarray(x, float) for x in b["_med"]]
        spread = [np.asarray(x, float) * 1.4826 for x in b["_mad"]]
        yield pd.DataFrame({"_group": b["_group"], "_centre": [c.tolist() for c in centre], "_scale": [_scale(np.diag(s**2)) for s in spread]})


def _concentrate(key: tuple, rows: pd.DataFrame, share: float) -> pd.DataFrame:
    """Centre and covariance of the nearest ``share`` of a group, from moments by range of distance."""
    rows = rows.sort_values("_range")
    n = rows["_n"].to_numpy()
    upto = int(np.searchsorted(np.cumsum(n), math.ceil(share * n.sum()))) + 1
    n, first = n[:upto].sum(), np.array([rows[f"_s{i}"].to_numpy()[:upto].sum() for i in range(P)])
    kept = n / rows["_n"].sum()
    second = np.zeros((P, P))
    for i in range(P):
        for j in range(i + 1):
            second[i, j] = second[j, i] = rows[f"_s{i}_{j}"].to_numpy()[:upto].sum()
    # Moments are about the last centre, so nothing cancels.
    shift = first / n
    cov = (second - n * np.outer(shift, shift)) / max(1, n - 1)
    # For normal data the nearest share alone would have too small a covariance.
    if kept < 1:
        cov = cov * (kept / chi2(chi2_point(kept, P), P + 2))
    centre = np.array(rows["_centre"].iloc[0], float) + shift
    return pd.DataFrame({"_group": [key[0]], "_centre": [centre.tolist()], "_scale": [_scale(cov)]})


_FOUND = "_group string, _centre array<double>, _scale array<double>"


def estimates(stats: DataFrame, share: float, steps_: int, least: int) -> DataFrame:
    """(_lang, _source, _group, _base, _centre, _scale) of ``stats`` (_lang, _source, _counts)."""
    strata = cut(_strata(stats, least))
    small = strata.count() <= BROADCAST_GROUPS
    near = F.broadcast if small else (lambda x: x)
    at = {c: i for i, c in enumerate(COUNTS)}
    # A document may count in its own group, its language and the whole table.
    known = stats.join(near(strata.select("_lang", "_source", F.explode("_pools").alias("_group"))), ["_lang", "_source"])
    sums = known.groupBy("_group").agg(*[F.sum(F.get("_counts", F.lit(i))).alias(c) for c, i in at.items()])
    base = sums.select("_group", F.array(*[F.coalesce(F.try_divide(F.col(of), F.col(among)), F.lit(0.0)) for of, among in RATIOS]).alias("_base"))
    base = cut(base)
    y = [f"_y{k}" for k in range(P)]
    vectors = known.join(near(base), "_group").select("_group", *[v.alias(c) for c, v in zip(y, _vector(F.col("_counts"), F.col("_base")))])
    med = vectors.groupBy("_group").agg(F.array(*[F.percentile_approx(c, 0.5, 2000) for c in y]).alias("_med"))
    med = cut(med)
    mad = vectors.join(near(med), "_group").groupBy("_group").agg(
        F.first("_med").alias("_med"), F.array(*[F.percentile_approx(F.abs(F.col(c) - F.get("_med", F.lit(k))), 0.5, 2000) for k, c in enumerate(y)]).alias("_mad")
    )
    found = cut(mad.mapInPandas(_start, _FOUND))
    for _ in range(steps_):
        d = [F.col(c) - F.get("_centre", F.lit(k)) for k, c in enumerate(y)]
        placed = vectors.join(near(found), "_group").withColumn("_range", F.floor(F.log2(1 + _distance([F.col(c) for c in y], F.col("_centre"), F.col("_scale"))) * _RANGES))
        moments = placed.groupBy("_group", "_range").agg(
            F.count(F.lit(1)).alias("_n"), F.first("_centre").alias("_centre"),
            *[F.sum(d[i]).alias(f"_s{i}") for i in range(P)], *[F.sum(d[i] * d[j]).alias(f"_s{i}_{j}") for i in range(P) for j in range(i + 1)],
        )
        found = cut(moments.groupBy("_group").applyInPandas(lambda key, rows: _concentrate(key, rows, share), _FOUND))
    return cut(strata.drop("_pools").join(base, "_group").join(found, "_group"))


def reject_outliers(
    docs: DataFrame, *, share: float = SHARE, steps: int = STEPS, least_group: int = LEAST_GROUP, limit: float = LIMIT, distance_column: str | None = None
) -> DataFrame:
    """``docs`` without those that lie more than ``limit`` standard deviations, by their Mahalanobis distance, from their group.

    Documents of a group of fewer than ``least_group`` are judged among all of their language, or of the whole table if
    these are too few; in a table of fewer, nobody is rejected. ``distance_column`` adds
    the squared distance (null in such a table), replacing a column of that name.

    Defined cases: a null language or source is the empty name; a null or empty text has all counts zero and
    so lies at its group's mean ratios: it stays, there being nothing to judge; repeated rows are judged alike and all
    stay or go, as do all documents of equal counts in a group; long texts are counted whole; one at the limit stays;
    all columns pass through whatever their names; an empty table gives an empty one.
    """
    names = docs.columns
    lang, source, counted = (unused(x, names) for x in ("_lang", "_source", "_counts"))
    measured = docs.withColumns({
        lang: F.coalesce(F.col("lang").cast("string"), F.lit("")), source: F.coalesce(F.col("source").cast("string"), F.lit("")),
        counted: F.arrow_udf(counts, "array<double>")(F.col("text")),
    })
    stats = cut(measured.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(counted).alias("_counts")))
    found = estimates(stats, share, steps, least_group)
    near = F.broadcast if found.count() <= BROADCAST_GROUPS else (lambda x: x)
    p = found.alias("p")
    out = measured.join(near(p), (measured[lang] == F.col("p._lang")) & (measured[source] == F.col("p._source")), "left")
    far = _distance(_vector(measured[counted], F.col("p._base")), F.col("p._centre"), F.col("p._scale"))
    out = out.where(F.coalesce(far <= limit * limit, F.lit(True)))
    keep = [measured[f"`{c}`"] for c in names if distance_column is None or c.lower() != distance_column.lower()]
    return out.select(*keep, *([] if distance_column is None else [far.alias(distance_column)]))
