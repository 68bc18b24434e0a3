"""Byte estimates of columns: what page and segment limits count.

Fixed widths count for every row, null or not; strings and lists count what they hold. Other types (booleans, dates, decimals, maps,
binaries) have no estimate, and a chunk with such a column counts as zero bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}
#: The offset that every row of a page carries while limits are applied.
INDEX_WIDTH = 4


def width(kind: T.DataType) -> int | None:
    return WIDTHS.get(type(kind))


def is_sized(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(is_sized(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return is_sized(kind.elementType)
    return isinstance(kind, T.StringType) or width(kind) is not None


def is_variable(kind: T.DataType) -> bool:
    return width(kind) is None


def size_of(column: Column, kind: T.DataType) -> Column:
    """Bytes of one value as a long; its type has to be sized."""
    n = width(kind)
    if n is not None:
        return F.lit(n).cast("long")
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        inner = width(kind.elementType)
        if inner is not None:
            return F.coalesce(F.size(column) * inner, F.lit(0)).cast("long")
        return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + size_of(x, kind.elementType)), F.lit(0).cast("long"))
    out = F.lit(0).cast("long")
    for f in kind.fields:
        out = out + size_of(column.getField(f.name), f.dataType)
    return out


def row_size(schema: T.StructType, index: bool = True) -> Column:
    """Bytes of a row, with the offset's width; zero where any column has no estimate."""
    if not all(is_sized(f.dataType) for f in schema.fields):
        return F.lit(0).cast("long")
    out = F.lit(INDEX_WIDTH if index else 0).cast("long")
    for f in schema.fields:
        out = out + size_of(F.col(f"`{f.name}`"), f.dataType)
    return out
