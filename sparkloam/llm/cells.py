"""Approximate nearest neighbours of some rows among all rows, by an inverted file of cells.

Unit vectors are put into the cell whose centre is nearest; centres come from spherical k-means over a bounded sample of
rows, and every row is in the index. A query is compared with all rows of the ``probes`` cells whose centres are nearest
to it. How many these must be depends on the vectors, so it is measured: some queries are compared with every
row, and ``probes`` is the least number of cells that hold the wanted share of their true neighbours.

Cells are packed into blocks of bounded size, and a query goes to those blocks that hold a cell it probes, with two bounds:
the similarity of the last centre it probes, and that of the ``k``-th neighbour that a sample of the rows in those cells has,
below which nothing is worth keeping. A task compares one block with up to ASKED queries, cell by cell, by products of matrices.
With about twice the square root of n cells, placing n rows takes n ** 1.5 products, and queries compare
themselves with a share of the rows that falls as the table grows, since its neighbours come nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import NEIGHBOURS, _matrix, commonest, keyed
from .common import blobs, discard, store

#: Share of the true neighbours of the measured queries that the probed cells must hold.
RECALL = 0.95
#: Queries that are compared with every row to choose the number of probes.
MEASURED = 256
#: Rows that centres are fitted on, and rows that bound a query's similarities from below.
SAMPLE = 65_536
BOUND = 16_384
MOST_CELLS = 8192
ROUNDS = 4
#: Rows of a block, at least and at most, and queries that meet a block in one task.
BLOCK = 4096, 262_144
ASKED = 131_072
#: Single precision's error in a product of unit vectors, with a margin.
_SLACK = 2e-6
_PENDING = 200_000


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _floats(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The vectors of a column of ``dims`` single floats in binary form."""
    parts = [np.frombuffer(c.buffers()[2], np.float32)[c.offset * dims : (c.offset + len(c)) * dims] for c in column.chunks if len(c)]
    return (parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.float32), *parts])).reshape(-1, dims)


def _bytes(x: np.ndarray) -> pa.Array:
    return blobs(x.astype(np.float32).reshape(-1), np.arange(len(x) + 1) * x.shape[1])


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centre."""
    out = np.empty(len(x), np.int32)
    for s in range(0, len(x), 1024):
        out[s : s + 1024] = (x[s : s + 1024] @ centres.T).argmax(axis=1)
    return out


def fit(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of spherical k-means, from vectors in random order; a centre that is nearest to none stays where it was."""
    centres = x[:cells].copy()
    for _ in range(rounds):
        cell = closest(x, centres)
        order = np.argsort(cell, kind="stable")
        some, first = np.unique(cell[order], return_index=True)
        total = np.add.reduceat(x[order], first, axis=0)
        length = np.linalg.norm(total, axis=1)
        good = length > 0
        centres[some[good]] = total[good] / length[good, None]
    return centres


def blocks_of(centres: np.ndarray, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, number of blocks) of each cell, and the number of all: near cells share blocks of up to ``block`` rows, a larger cell has some of its own."""
    groups = max(1, min(len(centres), int(counts.sum()) // block))
    near = closest(centres, fit(centres, groups)) if groups > 1 else np.zeros(len(centres), np.int32)
    first, parts = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    now, room = -1, 0
    for cell in np.argsort(near, kind="stable").tolist():
        if counts[cell] > block:
            parts[cell] = -(-counts[cell] // block)
            first[cell] = now + 1
            now, room = now + parts[cell], 0
            continue
        if now < 0 or counts[cell] > room:
            now, room = now + 1, block
        first[cell], room = now, room - counts[cell]
    return first, parts, int(now + 1)


def meet(asked: pa.Table, held: pa.Table, centres: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best of a block's rows for each query, as far as they lie in probed cells and above the query's bound."""
    dims = centres.shape[1]
    queries, keys = asked["_row"].combine_chunks(), held["_row"].combine_chunks()
    if not len(queries) or not len(keys):
        return pa.table({"_row": queries[:0], "_other": keys[:0], "_cos": pa.array([], pa.float64())})
    # Rows by cell, within it by key.
    by_key = pc.sort_indices(keys).to_numpy()
    order = by_key[np.argsort(held["_cell"].to_numpy()[by_key], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[by_key] = np.arange(len(order))
    rank, keys = rank[order], keys.take(pa.array(order))
    cell, x = held["_cell"].to_numpy()[order], _floats(held["_x"], dims)[order]
    q, least = _floats(asked["_x"], dims), asked["_least"].to_numpy()
    floor = asked["_bound"].to_numpy().copy()
    own = pc.fill_null(pc.index_in(queries, value_set=keys), -1).to_numpy()
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def compact() -> None:
        """Keep the best ``k`` of each query; the similarity doesn't depend on where a row stands."""
        nonlocal best, n
        a, b = (np.concatenate([p[i] for p in pending]) for i in (0, 1))
        other = own[a] != b
        a, b = a[other], b[other]
        cos = np.empty(len(a))
        for s in range(0, len(a), 65_536):
            cos[s : s + 65_536] = np.einsum("ij,ij->i", q[a[s : s + 65_536]].astype(float), x[b[s : s + 65_536]].astype(float))
        a, b, cos = np.concatenate([best[0], a]), np.concatenate([best[1], b]), np.concatenate([best[2], cos])
        by = np.lexsort((rank[b], -cos, a))
        a, b, cos = a[by], b[by], cos[by]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        last = place == k - 1
        floor[a[last]] = np.maximum(floor[a[last]], cos[last] - _SLACK)
        best = a[place < k], b[place < k], cos[place < k]
        pending.clear()
        n = 0

    some, first = np.unique(cell, return_index=True)
    ends = np.append(first[1:], len(cell))
    for g in range(0, len(some), 16):
        hits = q @ centres[some[g : g + 16]].T >= least[:, None]
        for j in range(hits.shape[1]):
            sub = np.flatnonzero(hits[:, j])
            for s in range(0, len(sub), 1024):
                part = sub[s : s + 1024]
                mine = q[part]
                for c in range(first[g + j], ends[g + j], 4096):
                    a, b = np.nonzero(mine @ x[c : min(c + 4096, ends[g + j])].T >= floor[part, None])
                    if len(a):
                        pending.append((part[a], b + c))
                        n += len(a)
                    if n > _PENDING:
                        compact()
    if pending:
        compact()
    return pa.table({"_row": queries.take(pa.array(best[0])), "_other": keys.take(pa.array(best[1])), "_cos": pa.array(best[2])})


def nearest(
    vectors: DataFrame, queries: Column, *, k: int = NEIGHBOURS, recall: float = RECALL, cells: int | None = None, sample: int = SAMPLE,
    block: int | None = None, asked: int = ASKED, key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine): of each row for which ``queries`` holds, the ``k`` most similar of all rows.

    About a share ``recall`` of the true neighbours is found, as measured on MEASURED queries of the table itself. ``cells`` is by default
    twice the square root of the number of rows, MOST_CELLS at most.

    Defined cases: rows with a null key, a null vector, one with a null or not finite value, one of zeros or of
    another length than most rows have are not compared and not in the result; of rows with equal keys
    only the first vector by order of its values is searched, and the row is a query if any of them is; among equal similarities the
    smaller key comes first; keys are integers or texts; a row has no rows if there is no other; an empty table gives an
    empty one; further columns are not read but those of ``queries``.
    """
    spark = vectors.sparkSession
    used, kind, held = keyed(vectors, key, column, queries)
    out = f"{key} {kind}, neighbour_id {kind}, rank int, cosine double"
    nothing = spark.createDataFrame([], out)
    used = store(used)
    dims, total = commonest(used)
    if not dims:
        return nothing
    hashed = F.xxhash64("_row")

    def some(rows: DataFrame, n: int, most: int, *columns: str) -> pa.Table:
        """About ``most`` rows to twice as many, cut to ``most``, in an order that follows nothing but their keys."""
        got = rows.select(hashed.alias("_h"), *columns).where(F.pmod("_h", F.lit(max(1, n // most))) == 0).toArrow()
        return got.take(pc.sort_indices(got, [("_h", "ascending")])[:most])

    fitted = _matrix(some(used.where(F.size("_v") == dims), total, sample, "_v")["_v"], dims)[1].astype(np.float32)
    # Without a usable row in the sample there is one cell, and any centre will do.
    cells = max(1, min(len(fitted), cells or min(MOST_CELLS, int(2 * total**0.5))))
    centres = fit(fitted, cells) if len(fitted) else np.ones((1, dims), np.float32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, 8192):
            rows, x = _matrix(t["_v"], dims)
            x, at = x.astype(np.float32), pa.array(rows)
            yield from pa.table({"_row": t["_row"].take(at), "_asks": t["_asks"].take(at), "_cell": closest(x, centres), "_x": _bytes(x)}).to_batches()

    rows = store(used.select("_row", "_asks", "_v").mapInArrow(placed, f"_row {held}, _asks boolean, _cell int, _x binary"))
    discard(used)
    counts = np.zeros(cells, np.int64)
    wanted = 0
    for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("_asks").alias("q")).collect():
        counts[r._cell], wanted = r.n, wanted + r.q
    if not wanted:
        return nothing

    some_queries = some(rows.where("_asks"), wanted, MEASURED, "_row", "_x")
    tried, names = _floats(some_queries["_x"], dims), some_queries["_row"].combine_chunks()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full((len(tried), k), -2.0, np.float32), np.zeros((len(tried), k), np.int32)
        for t in _gathered(batches, 8192):
            like = tried @ _floats(t["_x"], dims).T
            own = pc.index_in(t["_row"], value_set=names).combine_chunks()
            there = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
            like[own.drop_null().to_numpy(), there] = -2.0
            like = np.concatenate([best, like], axis=1)
            cell = np.concatenate([where, np.broadcast_to(t["_cell"].to_numpy(), (len(tried), len(t)))], axis=1)
            top = np.argpartition(-like, k - 1, axis=1)[:, :k]
            best, where = np.take_along_axis(like, top, 1), np.take_along_axis(cell, top, 1)
        a, b = np.nonzero(best > -2.0)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(where[a, b]), pa.array(best[a, b].astype(float))], ["_i", "_cell", "_cos"])

    order = F.row_number().over(Window.partitionBy("_i").orderBy(F.col("_cos").desc()))
    true = rows.select("_row", "_cell", "_x").mapInArrow(compared, "_i long, _cell int, _cos double").withColumn("_n", order).where(F.col("_n") <= k).select("_i", "_cell").collect()
    if not true:
        return nothing
    like = tried @ centres.T
    before = np.sort([(like[r._i] > like[r._i, r._cell]).sum() for r in true])
    probes = int(before[int(np.ceil(recall * len(before))) - 1]) + 1

    size = block or int(np.clip(counts.sum() // 24, *BLOCK))
    first, parts, blocks = blocks_of(centres, counts, size)
    member = np.zeros((cells, blocks), np.float32)
    for c in range(cells):
        member[c, first[c] : first[c] + parts[c]] = counts[c] > 0
    turns = -(-wanted // asked)
    bounding = some(rows, int(counts.sum()), BOUND, "_cell", "_x")
    known, lies = _floats(bounding["_x"], dims), bounding["_cell"].to_numpy()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, 8192):
            cell = t["_cell"].to_numpy()
            b = first[cell] + t["_h"].to_numpy() % parts[cell]
            for turn in range(turns):
                yield from pa.table({"_t": b * turns + turn, "_row": t["_row"], "_cell": t["_cell"], "_x": t["_x"]}).to_batches()

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, 1024):
            x = _floats(t["_x"], dims)
            like = x @ centres.T
            least = np.partition(like, cells - probes, axis=1)[:, cells - probes] - _SLACK
            bound = np.full(len(x), -2.0, np.float32)
            if len(known) > k:
                # Of rows that will be found, and of one more than wanted, since the query itself may be in the sample.
                there = x @ known.T
                there[~(like >= least[:, None] + _SLACK)[:, lies]] = -2.0
                bound = np.partition(there, len(known) - k - 1, axis=1)[:, len(known) - k - 1] - _SLACK
            a, b = np.nonzero((like >= least[:, None]).astype(np.float32) @ member)
            at = pa.array(a)
            yield from pa.table({
                "_t": b * turns + (t["_h"].to_numpy() % turns)[a], "_row": t["_row"].take(at), "_x": t["_x"].take(at),
                "_least": least[a].astype(np.float32), "_bound": bound[a].astype(np.float32),
            }).to_batches()

    numbered = rows.withColumn("_h", hashed)
    left = numbered.where("_asks").select("_row", "_h", "_x").mapInArrow(asking, f"_t long, _row {held}, _x binary, _least float, _bound float")
    right = numbered.select("_row", "_h", "_cell", "_x").mapInArrow(spread, f"_t long, _row {held}, _cell int, _x binary")
    met = left.groupBy("_t").cogroup(right.groupBy("_t")).applyInArrow(lambda a, b: meet(a, b, centres, k), f"_row {held}, _other {held}, _cos double")
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.col("_cos").desc(), "_other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("_row").cast(kind).alias(key), F.col("_other").cast(kind).alias("neighbour_id"), F.col("rank").cast("int"), F.col("_cos").alias("cosine")
    )
