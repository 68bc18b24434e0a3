"""Projection of (nested) columns: select, wildcard, exclude, flatten, unwrap, and columns nulled where they are too large.

``dataset`` names columns, or ``*`` for all top-level ones in place; they come out in the order asked for, repeats included.
With a ``separator``, names are paths into structs and every struct comes out as its leaves, ``a<sep>b<sep>c``, depth first.
``exclude`` drops exact paths, nested ones only with a separator; a struct's path drops all below it. Where one struct alone is left,
its fields become the columns. ``max_bytes`` turns a column to nulls in chunks where it is larger. Lists are leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizes import is_sized, size_of
from ..types import CHUNK, INDEX, PARTITION, Focus, PathError

Leaf = tuple[tuple[str, ...], T.DataType]


def column(path: tuple[str, ...]) -> Column:
    out = F.col(f"`{path[0]}`")
    for p in path[1:]:
        out = out.getField(p)
    return out


def lookup(schema: T.StructType, path: tuple[str, ...]) -> T.DataType:
    """Type at a path; PathError where a key is missing, or something on the way is no struct."""
    if not path or path == ("",):
        raise PathError("Empty")
    kind: T.DataType = schema
    for k, name in enumerate(path):
        if not isinstance(kind, T.StructType):
            raise PathError("NotStruct", ".".join(path[:k]))
        if name not in kind.fieldNames():
            raise PathError("KeyMissing", ".".join(path[: k + 1]))
        kind = kind[name].dataType
    return kind


def leaves(schema: T.DataType, path: tuple[str, ...]) -> list[Leaf]:
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in leaves(f.dataType, (*path, f.name))]
    return [(path, schema)]


def tables(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of all structs, depth first."""
    out: list[tuple[str, ...]] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [(*path, f.name), *tables(f.dataType, (*path, f.name))]
    return out


def arrays(schema: T.StructType) -> list[tuple[str, ...]]:
    """Paths of all columns that are no structs, depth first."""
    return [p for p, _ in leaves(schema, ())]


def table(df: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """The struct at a path as a table; NotStruct where it is something else."""
    if not isinstance(lookup(df.schema, path), T.StructType):
        raise PathError("NotStruct", ".".join(path))
    return df.select(column(path).alias("_t")).select("_t.*")


def to_struct(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unnest(df: DataFrame, *names: str) -> DataFrame:
    """Struct columns replaced by their fields; names that are not there, or no structs, are left alone."""
    cols = []
    for f in df.schema.fields:
        if f.name in names and isinstance(f.dataType, T.StructType):
            cols += [column((f.name, g)).alias(g) for g in f.dataType.fieldNames()]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def chosen(schema: T.StructType, focus: Focus) -> list[Leaf]:
    """Paths and types of the result's columns, before a single struct is unwrapped."""
    sep, out = focus.separator, []
    barred = {tuple(e.split(sep)) if sep else (e,) for e in focus.exclude}
    kept = lambda p: not any(p[: len(b)] == b for b in barred)
    for name in focus.dataset:
        if name == "*":
            tops: list[tuple[str, ...]] = [(f.name,) for f in schema.fields]
        else:
            tops = [tuple(name.split(sep)) if sep else (name,)]
        for path in tops:
            kind = lookup(schema, path)
            if kept(path):
                out += [x for x in leaves(kind, path) if kept(x[0])] if sep else [(path, kind)]
    if not out:
        raise PathError("Empty")
    return out


def apply(df: DataFrame, schema: T.StructType, focus: Focus) -> DataFrame:
    """``df`` (with the store's columns) as ``focus`` asks; offsets and partitions come along."""
    picked = chosen(schema, focus)
    name = lambda p: (focus.separator or ".").join(p)
    cols = []
    for path, kind in picked:
        c = column(path)
        if focus.max_bytes is not None and is_sized(kind):
            total = F.sum(size_of(c, kind)).over(Window.partitionBy(PARTITION, CHUNK))
            c = F.when(total <= focus.max_bytes, c)
        cols.append((name(path), c))
    if len(picked) == 1 and isinstance(picked[0][1], T.StructType) and not focus.separator:
        whole = cols[0][1]
        cols = [(f.name, whole.getField(f.name)) for f in picked[0][1].fields]
    return df.select(*[c.alias(n) for n, c in cols], PARTITION, INDEX)
