"""Typed JSON: every value is an object whose only key names the type of the value.

The schema of the parsed text says which tags each attribute ever uses, so unwrapping
is one nested expression built from that schema; no value is looked at in Python.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.names import quoted
from docweave.functions.stringify import as_text

# The type tags.
TEXT_TAGS = ("S", "N", "B")
SET_TAGS = ("SS", "NS", "BS")

Path = tuple[str, ...]

# Stands in a path for "any item".
ITEM = "[]"


def as_path(path: str | Sequence[str]) -> Path:
    return tuple(path.split(".")) if isinstance(path, str) else tuple(path)


def _untag(tag: str, value: Column, dtype: T.DataType, path: Path, lists: Collection[Path]):
    """(column, type) of the plain value under one tag."""
    if tag in TEXT_TAGS:
        return value.cast("string"), T.StringType()
    if tag == "BOOL":
        return value.try_cast("boolean"), T.BooleanType()
    if tag in SET_TAGS:
        return value.cast("array<string>"), T.ArrayType(T.StringType())
    if tag == "L":
        if not isinstance(dtype.elementType, (T.StructType, T.MapType)):
            # Only empty lists were seen: there is no element type.
            return F.transform(value, lambda _: F.lit(None)), T.ArrayType(T.NullType())
        column, element = _each(F.transform, value, dtype.elementType, (*path, ITEM), lists)
        return column, T.ArrayType(element)
    if tag == "M" and isinstance(dtype, T.MapType):
        column, element = _each(_transform_map, value, dtype.valueType, (*path, ITEM), lists)
        return column, T.MapType(T.StringType(), element)
    if tag == "M" and isinstance(dtype, T.StructType):
        return _unwrap_struct(value, dtype, path, lists)
    raise ValueError(f"{'.'.join(path)}: unknown type tag {tag!r}")


def _transform_map(value: Column, function) -> Column:
    return F.transform_values(value, lambda _, v: function(v))


def _each(transform, value: Column, dtype: T.DataType, path: Path, lists: Collection[Path]):
    """(column, type of an item) of the items of a list or map; they are walked once, while the lambda is built."""
    types = []

    def item(v: Column) -> Column:
        column, plain = _unwrap(v, dtype, path, lists)
        types.append(plain)
        return column

    return transform(value, item), types[0]


def _live_tags(dtype: T.StructType, path: Path, lists: Collection[Path]) -> list[T.StructField]:
    tags = [f for f in dtype.fields if f.name != "NULL"]
    if path in lists:
        tags = [f for f in tags if f.name == "L"]
    return tags


def unwrap_value(value: Column, dtype: T.DataType, path: Path = (), lists: Collection[Path] = ()) -> Column:
    """The plain value of one typed attribute.  Mixed types become text; ``lists`` keep their lists only."""
    return _unwrap(value, dtype, path, lists)[0]


def _unwrap(value: Column, dtype: T.DataType, path: Path, lists: Collection[Path]):
    """(column, type), found in one walk: a value is not looked at again for its type."""
    tags = _live_tags(dtype, path, lists) if isinstance(dtype, T.StructType) else []
    if isinstance(dtype, T.StringType) and path not in lists:
        return value, dtype  # never tagged, or tagged in some documents only: its JSON text
    if not tags:
        nothing = T.ArrayType(T.NullType()) if path in lists else T.StringType()
        return F.lit(None).cast(nothing), nothing
    plain = [_untag(f.name, value.getField(f.name), f.dataType, path, lists) for f in tags]
    if len({t.simpleString() for _, t in plain}) == 1:
        return F.coalesce(*[c for c, _ in plain]), plain[0][1]
    return F.coalesce(*[as_text(c, t) for c, t in plain]), T.StringType()


def _unwrap_struct(image: Column, dtype: T.StructType, path: Path, lists: Collection[Path]):
    plain = {f.name: _unwrap(image.getField(f.name), f.dataType, (*path, f.name), lists) for f in dtype.fields}
    fields = [column.alias(name) for name, (column, _) in plain.items()]
    return F.when(image.isNotNull(), F.struct(*fields)), T.StructType([T.StructField(n, t) for n, (_, t) in plain.items()])


def unwrap_struct(image: Column, dtype: T.StructType, path: Path = (), lists: Collection[Path] = ()) -> Column:
    """An attribute map as a plain struct, NULL where the map is."""
    return _unwrap_struct(image, dtype, path, lists)[0]


def typed_leaves(
    value: Column, dtype: T.StructType, path: Path = (), lists: Collection[Path] = ()
) -> Iterator[tuple[Path, Column, T.DataType]]:
    """(path, plain value, type) of every value of an attribute map that is not only ever a map.

    Each is one way down from ``value``: no struct is built on the way, so the plan stays small however deep maps nest.
    """
    for field in dtype.fields:
        below, inside = (*path, field.name), value.getField(field.name)
        tags = _live_tags(field.dataType, below, lists) if isinstance(field.dataType, T.StructType) else []
        if len(tags) == 1 and tags[0].name == "M" and isinstance(tags[0].dataType, T.StructType):
            yield from typed_leaves(inside.getField("M"), tags[0].dataType, below, lists)
        else:
            yield below, *_unwrap(inside, field.dataType, below, lists)


def unwrap_typed(
    df: DataFrame, image_col: str, lists: Sequence[str | Sequence[str]] = (), expand: bool = False
) -> DataFrame:
    """Replace the typed document in ``image_col`` by the plain one, or by its fields (``expand``)."""
    dtype = df.schema[image_col].dataType
    wanted = {as_path(p) for p in lists}
    if expand:
        image = F.col(quoted(image_col))
        rest = [F.col(quoted(c)) for c in df.columns if c != image_col]
        return df.select(
            *rest,
            *[unwrap_value(image.getField(f.name), f.dataType, (f.name,), wanted).alias(f.name) for f in dtype.fields],
        )
    return df.withColumn(image_col, unwrap_struct(F.col(quoted(image_col)), dtype, (), wanted))


def not_a_list(image: Column, dtype: T.DataType, path: str | Sequence[str]) -> Column:
    """True where the typed attribute at ``path`` holds something that is not a list."""
    names = as_path(path)
    for depth, name in enumerate(names):
        if not isinstance(dtype, T.StructType) or name not in dtype.names:
            return F.lit(False)
        image, dtype = image.getField(name), dtype[name].dataType
        if depth < len(names) - 1:
            if not isinstance(dtype, T.StructType) or "M" not in dtype.names:
                return F.lit(False)
            image, dtype = image.getField("M"), dtype["M"].dataType
    if not isinstance(dtype, T.StructType):
        return image.isNotNull() if isinstance(dtype, T.StringType) else F.lit(False)
    bad = F.lit(False)
    for field in dtype.fields:
        if field.name not in ("L", "NULL"):
            bad = bad | image.getField(field.name).isNotNull()
    return bad
