"""Schemas: what may be stored, when two are the same, and how Arrow's types become Spark's."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import types as T

from ..types import InvalidSchema, NullTypes

TIME = "time"
#: Field metadata key under which a widened type's origin is kept.
ORIGIN = "arrow_type"


def contains_null(kind: T.DataType) -> bool:
    if isinstance(kind, T.NullType):
        return True
    if isinstance(kind, T.StructType):
        return any(contains_null(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return contains_null(kind.elementType)
    if isinstance(kind, T.MapType):
        return contains_null(kind.keyType) or contains_null(kind.valueType)
    return False


def check(schema: T.StructType) -> None:
    """The first column is ``time``, a long of milliseconds; no column anywhere is of the null type; no name is the store's own."""
    if not schema.fields:
        raise InvalidSchema("there are no columns")
    first = schema.fields[0]
    if first.name != TIME:
        raise InvalidSchema(f"the first column must be {TIME!r}, not {first.name!r}")
    if not isinstance(first.dataType, T.LongType):
        raise InvalidSchema(f"{TIME!r} must be a 64-bit integer of milliseconds, not {first.dataType.simpleString()}")
    if contains_null(schema):
        raise NullTypes("columns of the null type cannot be stored")
    if taken := [f.name for f in schema.fields if f.name.startswith("__")]:
        raise InvalidSchema(f"names that begin with two underscores are the store's own: {taken}")


def canonical(schema: T.StructType, metadata: dict[str, str] | None = None) -> str:
    """Text that two schemas share if fields, order, nullability, field metadata and schema metadata are the same."""
    return json.dumps([json.loads(schema.json()), sorted((metadata or {}).items())], sort_keys=True)


def fingerprint(schema: T.StructType, metadata: dict[str, str] | None = None) -> str:
    return hashlib.sha256(canonical(schema, metadata).encode()).hexdigest()[:16]


def compatible(a: T.StructType | None, b: T.StructType | None, meta_a: dict | None = None, meta_b: dict | None = None) -> bool:
    """Whether rows of both fit one page; no schema fits any."""
    return a is None or b is None or canonical(a, meta_a) == canonical(b, meta_b)


def _cast(kind: pa.DataType) -> pa.DataType:
    """The nearest type that Spark can hold."""
    t = pa.types
    simple = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.date64(): pa.date32()}
    if kind in simple:
        return simple[kind]
    if t.is_time(kind):
        return pa.time64("us")
    if t.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if t.is_duration(kind):
        return pa.duration("us")
    if t.is_dictionary(kind):
        return _cast(kind.value_type)
    if t.is_run_end_encoded(kind):
        return _cast(kind.value_type)
    if t.is_decimal256(kind):
        return pa.decimal128(kind.precision, kind.scale) if kind.precision <= 38 else pa.string()
    if t.is_fixed_size_list(kind) or t.is_list(kind) or t.is_large_list(kind):
        return pa.list_(_field(kind.value_field))
    if t.is_struct(kind):
        return pa.struct([_field(kind.field(i)) for i in range(kind.num_fields)])
    if t.is_map(kind):
        return pa.map_(_cast(kind.key_type), _cast(kind.item_type))
    return kind


def _field(f: pa.Field) -> pa.Field:
    return pa.field(f.name, _cast(f.type), f.nullable)


def from_arrow(table: pa.Table) -> tuple[pa.Table, dict[str, dict[str, str]], dict[str, str]]:
    """An Arrow table in types that Spark holds, field metadata by column (with the origin of types that changed), and schema metadata.

    Unsigned integers widen, half floats become floats, dictionaries and run-length codes are decoded, nanoseconds
    are cut to microseconds, fixed-size lists keep their length in the metadata. Unions and calendar intervals are refused.
    """
    meta = {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()}
    fields: dict[str, dict[str, str]] = {}
    cols, out = [], []
    for f, col in zip(table.schema, table.columns, strict=True):
        if pa.types.is_null(f.type):
            raise NullTypes(f"column {f.name!r} is of the null type")
        if pa.types.is_union(f.type) or f.type == pa.month_day_nano_interval():
            raise InvalidSchema(f"type {f.type} of column {f.name!r} cannot be stored")
        kind = _cast(f.type)
        own = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
        if kind != f.type:
            own[ORIGIN] = str(f.type)
        if pa.types.is_dictionary(f.type):
            col = col.cast(f.type.value_type)
        elif pa.types.is_run_end_encoded(f.type):
            col = pa.chunked_array([pa.compute.run_end_decode(c) for c in col.chunks], f.type.value_type)
        fields[f.name] = own
        cols.append(col.cast(kind, safe=False))
        out.append(pa.field(f.name, kind, f.nullable))
    return pa.table(cols, schema=pa.schema(out)), fields, meta
