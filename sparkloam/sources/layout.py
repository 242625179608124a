"""Writing tables: grouped by index, sorted by time, cut into chunks, as Parquet that Spark can skip in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeline
from ..functions.rounding import round_columns
from ..spec import TableSpec
from .scratch import beside, delete, scratch

CHUNK = "chunk_no"
#: Stored with every row, and the same in all rows of a chunk: Parquet keeps a value once for a run of them.
BOUNDS = ("start_at", "end_at")
ROWS = "chunk_rows"
#: Distinct index keys up to which a table is partitioned by directory; with more it is clustered by ranges of the key.
DIRECTORIES = 1_000
DIR = "__dir_"
#: A row's place in its group.
PLACE = "__place"
#: Rows up to which an index group is numbered in one task. Tables with larger ones are sorted in ranges of about as many.
RANGE_ROWS = 131_072
#: Rows that a task sorts and writes of a table with large groups.
TASK_ROWS = 524_288


def _time(spec: TableSpec) -> Column | None:
    """What a group is sorted by."""
    if spec.timestamp is None:
        return None
    c = F.col(f"`{spec.timestamp}`")
    return F.coalesce(timeline.start(c), F.lit(0).cast("long")) if spec.fields[spec.timestamp].kind == "timeline" else c


def order_of(spec: TableSpec) -> list[Column]:
    time = _time(spec)
    return [*([] if time is None else [time]), *([F.col(f"`{spec.tiebreak}`")] if spec.tiebreak else [])]


def number_chunks(df: DataFrame, spec: TableSpec, stage: str | None = None) -> DataFrame:
    """``df`` with ``chunk_no``: the n-th ``chunk_size`` rows of an index group, in time order, are chunk n from 0.

    Without timestamp and tiebreak the order within a group is any. Rows of a table with large groups, or with neither index nor order,
    are stored in the folder ``stage`` first, with their places.
    """
    return _numbered(df, spec, stage)[0]


def _numbered(df: DataFrame, spec: TableSpec, stage: str | None) -> tuple[DataFrame, int | None]:
    """``df`` with ``chunk_no``, and its number of rows if groups are spread over tasks; None if each lies together."""
    keys, order = [F.col(f"`{c}`") for c in spec.index], order_of(spec)
    if not order and not keys:
        df = _stored(df.withColumn(PLACE, F.monotonically_increasing_id()), stage)
        return _chunked(_in_sequence(df), spec), df.count()
    rows, most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.sum("__n"), F.max("__n")).first()
    if (most or 0) > RANGE_ROWS:
        return _chunked(_by_ranges(df, keys, order, rows, stage), spec), rows
    w = Window.partitionBy(*keys).orderBy(*(order or [F.monotonically_increasing_id()]))
    return _chunked(df.withColumn(PLACE, F.row_number().over(w) - 1), spec), None


def _chunked(placed: DataFrame, spec: TableSpec) -> DataFrame:
    return placed.withColumn(CHUNK, F.floor(F.col(PLACE) / spec.chunk_size).cast("long")).drop(PLACE)


def _stored(df: DataFrame, stage: str | None) -> DataFrame:
    """``df`` as a table in ``stage``, of which later steps read single columns; what it computes is computed once."""
    spark = df.sparkSession
    path = f"{stage or scratch(spark, 'rows')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _in_sequence(stored: DataFrame) -> DataFrame:
    """Places from 0 without a gap, from those by task and row of ``monotonically_increasing_id``: no row moves for it."""
    task, row = F.shiftright(PLACE, 33), F.col(PLACE).bitwiseAND(F.lit(2**33 - 1))
    # One row a task.
    found = stored.groupBy(task.alias("__task")).agg((F.max(row) + 1).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    found = found.select("__task", F.coalesce(before, F.lit(0)).alias("__before"))
    return stored.join(F.broadcast(found), task == F.col("__task")).withColumn(PLACE, F.col("__before") + row).drop("__task", "__before")


def _by_ranges(df: DataFrame, keys: list[Column], order: list[Column], rows: int, stage: str | None) -> DataFrame:
    """Places from 0 by ``order`` within groups of any size: tasks sort ranges of keys and order, which are stored as they
    lie, and a row's place is that in its range and what its group has in ranges before."""
    by = [*keys, *order, F.col(PLACE)]  # ties lie in several ranges too
    sorted_rows = df.withColumn(PLACE, F.monotonically_increasing_id()).repartitionByRange(rows // RANGE_ROWS + 1, *by).sortWithinPartitions(*by)
    stored = _stored(sorted_rows.withColumn(PLACE, F.monotonically_increasing_id()), stage)
    names = [f"__k{i}" for i in range(len(keys))]
    task, row = F.shiftright(PLACE, 33), F.col(PLACE).bitwiseAND(F.lit(2**33 - 1))
    parts = stored.groupBy(*[c.alias(n) for c, n in zip(keys, names)], task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"), F.min(row).alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*names).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*names, "__task", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__more"))
    same = task == F.col("__task")
    for c, n in zip(keys, names):
        same = same & c.eqNullSafe(F.col(n))
    return stored.join(parts, same).withColumn(PLACE, row + F.col("__more")).drop("__task", "__more", *names)


def _line(spec: TableSpec) -> bool:
    return spec.timestamp is not None and spec.fields[spec.timestamp].kind == "timeline"


def _ends(spec: TableSpec) -> list[Column]:
    """First and last time of a row."""
    c = F.col(f"`{spec.timestamp}`")
    return [timeline.start(c), timeline.end(c)] if _line(spec) else [c, c]


def bounds_of(spec: TableSpec) -> tuple[str, ...]:
    """Names of a chunk's bounds, none if the table has no timestamp or fields of these names."""
    return BOUNDS if spec.timestamp and not set(BOUNDS) & set(spec.fields) else ()


def with_bounds(chunked: DataFrame, spec: TableSpec) -> DataFrame:
    """``chunked`` with what there is to know of a row's chunk. Rows of a chunk lie together already, so nothing is shuffled."""
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in spec.index], CHUNK)
    out = {ROWS: F.count(F.lit(1)).over(w)}
    if bounds_of(spec):
        first, last = _ends(spec)
        out |= {"start_at": F.min(first).over(w), "end_at": F.max(last).over(w)}
    return chunked.withColumns(out)


def prepare(df: DataFrame, spec: TableSpec, stage: str | None = None) -> DataFrame:
    """Rows as they are stored: runs collapsed on the values as given, chunks numbered, then fields rounded."""
    return _prepared(df, spec, stage)[0]


def _prepared(df: DataFrame, spec: TableSpec, stage: str | None) -> tuple[DataFrame, bool]:
    """``prepare``, and whether rows lie in tasks as they are to be written."""
    df = df.select(*[F.col(f"`{c}`") for c in spec.fields])
    if _line(spec):
        df = timeline.collapse_runs(df, spec)
        bad = F.assert_true(F.size(F.col(f"`{spec.timestamp}`")) > 0, F.lit("a stored row has a timeline that is not empty"))
        df = _stored(df.where(F.coalesce(bad.cast("boolean"), F.lit(True))), stage)
    df, rows = _numbered(df, spec, stage)
    if not spec.index and not order_of(spec):
        df = df.withColumn(ROWS, F.least(F.lit(spec.chunk_size), F.lit(rows) - F.col(CHUNK) * spec.chunk_size).cast("long"))
    elif rows is not None:
        df = with_bounds(df.repartitionByRange(rows // TASK_ROWS + 1, *[F.col(f"`{c}`") for c in spec.index], CHUNK), spec)
    else:
        df = with_bounds(df, spec)
    # Bounds are those of the values before rounding, which come from the same columns otherwise.
    return (df.withColumns(round_columns(spec)) if round_columns(spec) else df), rows is not None


def write(df: DataFrame, spec: TableSpec, path: str, *, by_directory: bool | None = None, mode: str = "errorifexists") -> None:
    """Write a table. With few index keys each has a directory, which filters on the index prune; with many, files
    hold ranges of the key, whose statistics prune. Either way a file is sorted by index, chunk and time, and its size
    follows ``spark.sql.adaptive.advisoryPartitionSizeInBytes``: a large key is spread over several (of about ``TASK_ROWS`` rows), small ones share tasks.
    Rows without index, timestamp and tiebreak stay where they are. These and tables with large index groups are stored in a folder beside ``path`` on the way."""
    keys = [F.col(f"`{c}`") for c in spec.index]
    if by_directory is None:
        by_directory = bool(keys) and df.select(*keys).distinct().limit(DIRECTORIES + 1).count() <= DIRECTORIES
    stage = beside(path)
    try:
        stored, spread = _prepared(df, spec, stage)
        if spread:
            stored = stored.sortWithinPartitions(*keys, CHUNK, *order_of(spec)) if keys or order_of(spec) else stored
        elif by_directory and keys:
            stored = stored.hint("rebalance", *keys).sortWithinPartitions(*keys, CHUNK, *order_of(spec))
        elif keys:
            stored = stored.repartitionByRange(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, *order_of(spec))
        elif order_of(spec):
            stored = stored.repartitionByRange(*order_of(spec)).sortWithinPartitions(*order_of(spec))
        if by_directory:
            stored = stored.select("*", *[F.concat(F.lit("_"), F.col(f"`{c}`")).alias(_folder(c, spec)) for c in spec.index if _folder(c, spec) != c])
            stored = stored.drop(*[c for c in spec.index if _folder(c, spec) != c])
        out = stored.write.mode(mode).option("compression", "zstd")
        if by_directory and keys:
            out = out.partitionBy(*[_folder(c, spec) for c in spec.index])
        out.parquet(path)
    finally:
        delete(df.sparkSession, stage)


def _folder(name: str, spec: TableSpec) -> str:
    """The column that directories go by. An empty name is none, so texts have a character before them there."""
    return f"{DIR}{name}" if spec.fields[name].kind in ("string", "uuid") else name


def read(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """All rows of a written table, with ``chunk_no`` and what is stored of chunks; its schema is the specification's, no inference."""
    kinds = {f.name: f.dataType for f in spec.schema().fields}
    schema = spec.schema().add(CHUNK, "long").add(ROWS, "long")
    for b in bounds_of(spec):
        schema = schema.add(b, "long" if _line(spec) else kinds[spec.timestamp])
    stored = spark.read.schema(schema).parquet(path)

    def column(c: str) -> Column:
        if f"{DIR}{c}" in stored.columns:
            return F.substring(F.col(f"`{DIR}{c}`"), 2, 2**31 - 1).alias(c)
        return F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in spec.index else F.col(f"`{c}`")

    return stored.select(*[column(c) for c in spec.fields], CHUNK, ROWS, *bounds_of(spec))


def chunk_metadata(chunked: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per chunk: its index values, number, rows, and ``start_at`` and ``end_at`` if there is a timestamp.

    Of a stored table only the columns that tell of chunks are read, no timestamps and no payload.
    """
    if ROWS in chunked.columns:
        names = [*[F.col(f"`{c}`") for c in spec.index], F.col(CHUNK), *[F.col(b) for b in bounds_of(spec)]]
        return chunked.select(*names, F.col(ROWS).alias("n")).distinct()
    found = [F.count(F.lit(1)).alias("n")]
    if spec.timestamp:
        first, last = _ends(spec)
        found = [F.min(first).alias("start_at"), F.max(last).alias("end_at"), *found]
    return chunked.groupBy(*[F.col(f"`{c}`") for c in spec.index], CHUNK).agg(*found)


def expand(chunked: DataFrame, spec: TableSpec, chunk_no: int, **index: object) -> DataFrame:
    """The rows of one chunk."""
    out = chunked.where(F.col(CHUNK) == chunk_no)
    for name in spec.index:
        out = out.where(F.col(f"`{name}`") == F.lit(index[name]))
    return out.select(*spec.fields)
