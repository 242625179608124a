"""Canonical JSON: sorted keys, no spaces, integers and floats apart. Equal values have equal texts."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _floats(x, digits):
    if isinstance(x, float):
        scale = 10.0**digits
        y = x * scale
        return x if not math.isfinite(y) else math.copysign(math.floor(abs(y) + 0.5) if abs(y) < 2**52 else abs(y), y) / scale
    if isinstance(x, dict):
        return {k: _floats(v, digits) for k, v in x.items()}
    return [_floats(v, digits) for v in x] if isinstance(x, list) else x


def canonical(text: str, digits: int | None = None) -> str:
    value = json.loads(text)
    return json.dumps(value if digits is None else _floats(value, digits), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(column: Column, digits: int | None = None) -> Column:
    """Canonical text of a JSON column, floats rounded to ``digits``; for use when rows are taken in. Null for null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else canonical(x, digits))

    return run(column)
