"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

Vectors are normalised, centred, turned to their principal axes and then by a rotation that brings them
close to the corners of the cube (iterative quantisation, Gong and Lazebnik, 2011); signs are the
code. Codes are split into substrings, each indexed by value. Two codes within ``radius`` differ by at
most ``radius // m`` bits in one of the ``m`` substrings (by one less in those after the first
``radius % m + 1``; Norouzi, Punjani and Fleet, 2012), so probing each index with all values so near
retrieves every code within the radius. What is retrieved is reranked by its floats.

Every row is a query. Rows are spread over blocks by a hash; each pair of blocks is one task, which
builds the index of one block and probes it with the other's codes, so tasks have a fixed size and
nothing is broadcast but the rotation. Principal axes and rotation are sums over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of 64 within which neighbours are retrieved. Vectors that point in all directions alike need so many for a recall of 0.9;
#: those that cluster have nearer neighbours, and less is found at less cost with fewer.
RADIUS = 30
NEIGHBOURS = 10
#: Bits of a substring.
SUBSTRING = 8
ROUNDS = 15
#: Rows of a block.
BLOCK = 8192


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of those rows that have ``dims`` finite values, not all of them zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dims)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    length = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return rows[good], x[good] / length[good, None]


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    n, first, second = 0, np.zeros(dims), np.zeros((dims, dims))
    for batch in batches:
        _, x = _matrix(batch.column(0), dims)
        n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
    flat = np.concatenate([[n], first, second.reshape(-1)])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["_i", "_v"])


def _summed(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in df.groupBy("_i").agg(F.sum("_v").alias("_v")).collect():
        out[r._i] = r._v
    return out


class Rotation:
    """A learned binary code: the signs of rotated, centred unit vectors."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray) -> None:
        self.centre, self.axes = centre, axes

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.axes


def learn(vectors: DataFrame, column: str, dims: int, bits: int, rounds: int, seed: int = 3) -> Rotation | None:
    """The rotation for ``bits`` principal axes, by sums over all rows; None without any usable row."""
    part = vectors.select(F.col(column).alias("_x"))
    m = _summed(part.mapInArrow(lambda it: _moments(it, dims), "_i long, _v double"), 1 + dims + dims * dims)
    if not m[0]:
        return None
    centre = m[1 : 1 + dims] / m[0]
    cov = m[1 + dims :].reshape(dims, dims) / m[0] - np.outer(centre, centre)
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :bits]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        now = Rotation(centre, axes @ turn)

        def step(batches: Iterator[pa.RecordBatch], now: Rotation = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((bits, bits))
            for batch in batches:
                _, x = _matrix(batch.column(0), dims)
                v = (x - now.centre) @ axes
                total += np.where(now.project(x) > 0, 1.0, -1.0).T @ v
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits * bits)), pa.array(total.reshape(-1))], ["_i", "_v"])

        u, _, vt = np.linalg.svd(_summed(part.mapInArrow(step, "_i long, _v double"), bits * bits).reshape(bits, bits))
        turn = (u @ vt).T
    return Rotation(centre, axes @ turn)


def radii(radius: int, m: int) -> list[int]:
    """Per substring the distance within which one of them lies if whole codes lie within ``radius``."""
    return [radius // m if j <= radius % m else radius // m - 1 for j in range(m)]


def search(query: tuple, index: tuple, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, row of the index, cosine) of the best ``k`` of the codes within ``radius``.

    Both sides are (codes as bytes, unit vectors, keys); a row is not its own neighbour.
    """
    (qc, qx, qk), (ic, ix, ik) = query, index
    m = qc.shape[1]
    bytes_ = np.arange(256)
    near = np.bitwise_count((bytes_[:, None] ^ bytes_[None, :]).astype(np.uint8))
    wide_q, wide_i = (np.ascontiguousarray(c).view(np.uint8) for c in (qc, ic))
    best = np.full((len(qc), k), -2.0, np.float32)
    which = np.full((len(qc), k), -1, np.int64)
    for j, r in enumerate(radii(radius, m)):
        if r < 0:
            continue
        order = np.argsort(ic[:, j], kind="stable")
        first = np.searchsorted(ic[order, j], np.arange(257))
        for value in np.unique(qc[:, j]).tolist():
            q = np.flatnonzero(qc[:, j] == value)
            probes = np.flatnonzero(near[value] <= r)
            found = np.concatenate([order[first[p] : first[p + 1]] for p in probes])
            if not len(found):
                continue
            for s in range(0, len(q), 512):
                part = q[s : s + 512]
                like = qx[part] @ ix[found].T
                apart = np.zeros(like.shape, np.uint8)
                for b in range(m):
                    apart += near[wide_q[part, b][:, None], wide_i[found, b][None, :]]
                like[(apart > radius) | (qk[part][:, None] == ik[found][None, :])] = -2.0
                top = np.argpartition(-like, min(k, like.shape[1]) - 1, axis=1)[:, :k]
                pool = np.concatenate([best[part], np.take_along_axis(like, top, 1)], axis=1)
                names = np.concatenate([which[part], found[top]], axis=1)
                # A code found by several substrings counts once.
                by = np.lexsort((names, -pool), axis=1)
                pool, names = np.take_along_axis(pool, by, 1), np.take_along_axis(names, by, 1)
                again = np.zeros(names.shape, bool)
                for c in range(1, names.shape[1]):
                    again[:, c] = (names[:, :c] == names[:, c : c + 1]).any(axis=1)
                pool[again] = -2.0
                by = np.argsort(-pool, axis=1, kind="stable")[:, :k]
                best[part], which[part] = np.take_along_axis(pool, by, 1), np.take_along_axis(names, by, 1)
    row, col = np.nonzero(best > -2.0)
    return row, which[row, col], best[row, col].astype(np.float64)


def _pairs(left: pd.DataFrame, right: pd.DataFrame, radius: int, k: int) -> pd.DataFrame:
    def side(rows: pd.DataFrame) -> tuple:
        codes = np.frombuffer(b"".join(rows["_code"]), np.uint8).reshape(len(rows), -1)
        x = np.frombuffer(b"".join(rows["_x"]), np.float32).reshape(len(rows), -1)
        return codes, x, rows["_row"].to_numpy()

    empty = pd.DataFrame({"_row": left["_row"].iloc[:0], "_other": right["_row"].iloc[:0], "_cos": pd.Series([], dtype="float64")})
    if left.empty or right.empty:
        return empty
    q, i = side(left), side(right)
    a, b, like = search(q, i, radius, k)
    return pd.DataFrame({"_row": q[2][a], "_other": i[2][b], "_cos": like}) if len(a) else empty


def keyed(vectors: DataFrame, key: str, column: str, asks: Column | None = None) -> tuple[DataFrame, str, str]:
    """(_row, _v, and _asks if given) of rows with a key and a vector without nulls, one a key; the key's type, and that of ``_row``."""
    kind = vectors.schema[key].dataType.simpleString()
    held = "long" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    used = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull() & ~F.exists(F.coalesce(F.col(column), F.array()), lambda x: x.isNull()))
    asked = [] if asks is None else [F.max(F.coalesce(asks, F.lit(False))).alias("_asks")]
    return used.groupBy(F.col(key).cast(held).alias("_row")).agg(F.min(column).alias("_v"), *asked), kind, held


def commonest(used: DataFrame) -> tuple[int, int]:
    """The length that most of the vectors ``_v`` have, and how many have it; (0, 0) if there is none."""
    sizes = used.groupBy(F.size("_v").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "_d").first()
    return (sizes._d, sizes._n) if sizes is not None and sizes._d else (0, 0)


def neighbours(
    vectors: DataFrame, *, k: int = NEIGHBOURS, radius: int | None = None, bits: int | None = None, rounds: int = ROUNDS, block: int = BLOCK,
    key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine): of every row the ``k`` most similar of the rows whose code is within
    ``radius`` of its own. ``bits`` is a multiple of 8; by default that of the vectors' dimensions below 65.

    The radius decides the recall; it is RADIUS of 64 bits, or the same share of fewer, whatever the table's size.

    Defined cases: rows with a null key, a null vector, one with a null or not finite value, one of zeros or of
    another length than most rows have are not compared and not in the result; rows with equal keys are
    never neighbours of each other, and of such rows only the first vector by order of its values is searched;
    among equal similarities the smaller key comes first; keys are integers or texts; a row without a code within the radius has no
    rows; an empty table gives an empty one; further columns are not read.
    """
    spark = vectors.sparkSession
    used, kind, held = keyed(vectors, key, column)
    out = f"{key} {kind}, neighbour_id {kind}, rank int, cosine double"
    used = cut(used)
    dims, n = commonest(used)
    if not dims:
        return spark.createDataFrame([], out)
    bits = bits or max(8, min(64, dims) // 8 * 8)
    used = used.where(F.size("_v") == dims)
    if dims < bits:
        raise ValueError("a code has at most as many bits as vectors have dimensions")
    radius = RADIUS * bits // 64 if radius is None else radius
    rotation = learn(used, "_v", dims, bits, rounds)
    if rotation is None:
        return spark.createDataFrame([], out)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column("_v"), dims)
            code = np.packbits(rotation.project(x) > 0, axis=1)
            flat = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(rows)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in flat], pa.binary())],
                ["_row", "_code", "_x"],
            )

    blocks = max(1, -(-n // block))
    codes = used.mapInArrow(coded, f"_row {held}, _code binary, _x binary").withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))
    codes = cut(codes)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = codes.withColumn("_o", other).groupBy("_b", "_o")
    right = codes.withColumnRenamed("_b", "_o").withColumn("_b", other).groupBy("_b", "_o")
    met = left.cogroup(right).applyInPandas(lambda a, b: _pairs(a, b, radius, k), f"_row {held}, _other {held}, _cos double")
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.col("_cos").desc(), "_other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("_row").cast(kind).alias(key), F.col("_other").cast(kind).alias("neighbour_id"), F.col("rank").cast("int"), F.col("_cos").alias("cosine")
    )
