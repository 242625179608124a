"""Helpers that the operators share: vectorised word splitting and hashing, lineage cuts, names."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 2_000_000
#: Rows of an Arrow batch: 500 documents of 100 KB are 50 MB in a Python worker.
BATCH_ROWS = 500

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 2**64)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _shared(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only a session on one machine may leave it unset, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sparkloam-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver's collector has found them unused.

    Events that still wait for their listeners hold the plans that they tell of.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``, a small table, in the shared folder and cut its lineage. The files outlive any executor."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like ``cut``, for large tables: a compressed table of which later steps read single columns.

    It lies in a folder of this application's own under the shared folder. What ``df`` has shuffled is freed.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/sparkloam-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    _release(spark)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def discard(stored: DataFrame) -> None:
    """Delete the table of ``store``, of which nothing is read any more."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps count by their entries, whatever their order."""
    parts = []
    for field in docs.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind.startswith("map<") and kind.count("map<") == 1 and "variant" not in kind:
            c = F.array_sort(F.map_entries(c))
        elif "map<" in kind or "variant" in kind:
            c = F.to_json(F.struct(c.alias("c")))
        parts.append(c)
    return F.xxhash64(*parts)


def unused(stem: str, columns: list[str]) -> str:
    """A column name that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{uuid.uuid4().hex[:8]}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 by Steele, Lea and Flood: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_MULT) + U64(salt))


class Hasher:
    """Hashes of byte ranges from one running polynomial sum modulo 2**64.

    Bytes are first mapped to random words, the base is odd and so has an inverse, and results
    are mixed. Anything that hashes pair up is compared exactly afterwards where that matters.
    """

    def __init__(self) -> None:
        self.table = seeds(256, 77)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, STEP_BYTES + 1)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[U64(1)], np.full(size, _MULT, U64)]), dtype=U64)
                self.down = np.cumprod(np.concatenate([[U64(1)], np.full(size, _INV, U64)]), dtype=U64)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        self.grow(n)
        total = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.up[:n], out=total[1:])
            return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(U64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of several texts: maximal runs of bytes that are not ASCII white space.

    ``start``/``end`` are byte ranges in ``data``; the words of text ``i`` are those from
    ``first[i]`` to ``first[i + 1]``. A null text has no words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        if n:
            edge = offsets[(offsets > 0) & (offsets < n)]
            begins[edge] = inside[1:-1][edge]
            ends[edge - 1] = inside[1:-1][edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column, without a copy of its text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    kind = np.int64 if large else np.int32
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of at most ``most`` bytes of text, or of one row: (from, to, bytes, offsets)."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def distinct_in_owner(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, ordered by owner and value. ``owner`` ascends."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    if len(v):
        keep = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
        o, v = o[keep], v[keep]
    return o, v


def lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """An Arrow list column: row i holds ``values[first[i]:first[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """An Arrow binary column: row i holds the bytes of ``values[first[i]:first[i + 1]]``."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(first) - 1,
        [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))],
    )
