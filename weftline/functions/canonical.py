"""One JSON text for each value: sorted keys at every depth, no blanks, ASCII, nulls kept."""

from __future__ import annotations

import datetime
import hashlib
import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(value, kind: pa.DataType):
    """A value of Arrow as JSON knows it; what JSON doesn't know is an error."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _plain(value[f.name], f.type) for f in kind}
    if pa.types.is_map(kind):
        return {str(k): _plain(v, kind.item_type) for k, v in value}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [_plain(x, kind.value_type) for x in value]
    if isinstance(value, (bytes, datetime.date, datetime.timedelta)) or pa.types.is_decimal(kind):
        raise ValueError(f"JSON has no {kind}")
    return value


def dumps(value) -> str:
    """Canonical JSON of a Python value; not-a-number and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.arrow_udf(T.StringType())
def canonical_json(value: pa.Array) -> pa.Array:
    """Canonical JSON of a struct, map, array or plain column; a null is ``null``."""
    return pa.array([dumps(_plain(x, value.type)) for x in value.to_pylist()], pa.string())


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical_sha256(value):
    """sha256 of a column's canonical JSON."""
    return F.sha2(canonical_json(value), 256)
