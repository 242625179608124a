"""Logical types and table specifications: schema, roles, rounding and chunk size."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_BOUNDS = {
    "i8": (-(2**7), 2**7 - 1), "i16": (-(2**15), 2**15 - 1), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1),
    "u8": (0, 2**8 - 1), "u16": (0, 2**16 - 1), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1),
}
FLOATS = ("f16", "f32", "f64")
EPOCH = datetime(1970, 1, 1)

_SCALARS: dict[str, T.DataType] = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f16": T.FloatType(), "f32": T.FloatType(), "f64": T.DoubleType(), "bool": T.BooleanType(),
    "string": T.StringType(), "bytes": T.BinaryType(), "uuid": T.StringType(), "json": T.StringType(), "datetime": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class Type:
    """A logical type. ``items`` are its element types, ``names`` those of a struct's fields or an enum's variants.

    Unsigned integers are held one width up, u64 as DECIMAL(20, 0), f16 as FLOAT, datetimes as
    TIMESTAMP_NTZ in UTC, UUIDs and JSON as canonical strings, a doubly optional value as STRUCT<value>.
    """

    kind: str
    items: tuple["Type | None", ...] = ()
    names: tuple[str, ...] = ()
    tags: tuple[int, ...] = ()
    default: int = 0
    bucket: int = 0
    float_round: int | None = None
    time_round: timedelta | None = None

    @property
    def item(self) -> "Type":
        assert self.items[0] is not None
        return self.items[0]

    @property
    def with_payload(self) -> bool:
        return self.kind == "enum" and any(t is not None for t in self.items)


I8, I16, I32, I64, U8, U16, U32, U64, F16, F32, F64, BOOL, STRING, BYTES, UUID, JSON, DATETIME = (
    Type(k) for k in ("i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64", "f16", "f32", "f64", "bool", "string", "bytes", "uuid", "json", "datetime")
)


def Option(item: Type) -> Type:
    return Type("option", (item,))


def Vec(item: Type) -> Type:
    return Type("vec", (item,))


def Map(key: Type, value: Type) -> Type:
    return Type("map", (key, value))


def Tuple(*items: Type) -> Type:
    if not 2 <= len(items) <= 6:
        raise ValueError("a tuple has two to six elements")
    return Type("tuple", items)


def Struct(fields: Mapping[str, Type], float_round: int | None = None, time_round: timedelta | None = None) -> Type:
    """A nested struct; it has its own rounding and doesn't take its parent's."""
    return Type("struct", tuple(fields.values()), tuple(fields), float_round=float_round, time_round=time_round)


def Enum(variants: Mapping[str, int | tuple[int, Type] | None], default: str | None = None, float_round: int | None = None) -> Type:
    """An enum by variant name: a tag, a tag and payload, or None for the tag after the one before (0 at first)."""
    tags: list[int] = []
    items: list[Type | None] = []
    for v in variants.values():
        tag, item = v if isinstance(v, tuple) else (v, None)
        tags.append((tags[-1] + 1 if tags else 0) if tag is None else tag)
        items.append(item)
    if len(set(tags)) < len(tags):
        raise ValueError("variants have distinct tags")
    names = tuple(variants)
    return Type("enum", tuple(items), names, tuple(tags), tags[names.index(default)] if default else tags[0], float_round=float_round)


def Timeline(bucket: int = 0) -> Type:
    """A set of closed microsecond intervals; with a bucket width, of whole buckets."""
    if bucket < 0:
        raise ValueError("a bucket's width is not negative")
    return Type("timeline", bucket=bucket)


def spark_type(t: Type) -> T.DataType:
    if t.kind in _SCALARS:
        return _SCALARS[t.kind]
    if t.kind == "option":
        inner = spark_type(t.item)
        return T.StructType([T.StructField("value", inner)]) if t.item.kind == "option" else inner
    if t.kind == "vec":
        return T.ArrayType(spark_type(t.item))
    if t.kind == "map":
        return T.MapType(spark_type(t.items[0]), spark_type(t.items[1]))
    if t.kind == "timeline":
        return T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    if t.kind == "tuple":
        return T.StructType([T.StructField(f"_{i}", spark_type(x)) for i, x in enumerate(t.items)])
    if t.kind == "struct":
        return T.StructType([T.StructField(n, spark_type(x)) for n, x in zip(t.names, t.items)])
    if t.kind == "enum":
        if not t.with_payload:
            return T.LongType()
        return T.StructType([T.StructField("tag", T.LongType()), *[T.StructField(variant(tag), spark_type(x)) for tag, x in zip(t.tags, t.items) if x]])
    raise ValueError(f"unknown type {t.kind}")


def variant(tag: int) -> str:
    """Name of the column of a variant's payload."""
    return f"variant_{tag}".replace("-", "m")


def default_value(t: Type) -> Any:
    """The value of a field that a row lacks, in Python."""
    if t.kind in INT_BOUNDS:
        return Decimal(0) if t.kind == "u64" else 0
    if t.kind in FLOATS:
        return 0.0
    if t.kind in ("tuple", "struct"):
        return {f.name: default_value(x) for f, x in zip(spark_type(t).fields, t.items)}
    if t.kind == "enum":
        return {"tag": t.default} if t.with_payload else t.default
    return {"bool": False, "string": "", "bytes": b"", "uuid": str(uuid.UUID(int=0)), "json": "null", "datetime": EPOCH, "option": None}.get(t.kind, {} if t.kind == "map" else [])


def default_column(t: Type) -> Column:
    kind = spark_type(t)
    if t.kind in ("tuple", "struct"):
        return F.struct(*[default_column(x).alias(f.name) for f, x in zip(kind.fields, t.items)])
    if t.kind == "enum" and t.with_payload:
        out = [F.lit(t.default).cast("long").alias("tag")]
        for tag, x in zip(t.tags, t.items):
            if x:
                out.append((default_column(x) if tag == t.default else F.lit(None).cast(spark_type(x))).alias(variant(tag)))
        return F.struct(*out)
    if t.kind in ("vec", "timeline"):
        return F.array().cast(kind)
    if t.kind == "map":
        return F.create_map().cast(kind)
    return F.lit(default_value(t)).cast(kind)


@dataclass(frozen=True)
class TableSpec:
    """A table: its fields in order, the index fields, the timestamp field, rounding and rows per chunk.

    ``tiebreak`` orders rows of equal timestamps; without one their order is any.
    """

    fields: Mapping[str, Type]
    index: tuple[str, ...] = ()
    timestamp: str | None = None
    float_round: int | None = None
    time_round: timedelta | None = None
    chunk_size: int = 32_768
    tiebreak: str | None = None
    enum: Type | None = field(default=None)

    def __post_init__(self) -> None:
        if self.float_round is not None and not 1 <= self.float_round <= 8:
            raise ValueError("float_round is from 1 to 8")
        if self.chunk_size < 1:
            raise ValueError("chunk_size is at least 1")
        for name in (*self.index, *filter(None, (self.timestamp, self.tiebreak))):
            if name not in self.fields:
                raise ValueError(f"Unknown field: {name}")
        for name in self.index:
            if self.fields[name].kind not in (*INT_BOUNDS, "string", "uuid", "bool"):
                raise ValueError(f"field '{name}' can't be an index: integers, strings, UUIDs and booleans can")
        if self.timestamp and self.fields[self.timestamp].kind not in ("datetime", "timeline", "i64"):
            raise ValueError(f"field '{self.timestamp}' can't be the timestamp: datetimes, timelines and i64 can")
        if self.timestamp in self.index:
            raise ValueError("the timestamp is no index field")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(t)) for n, t in self.fields.items()])


def enum_table(t: Type) -> TableSpec:
    """The table of one enum column ``value``, filtered with the key ""."""
    return TableSpec({"value": t}, enum=t, float_round=t.float_round)
