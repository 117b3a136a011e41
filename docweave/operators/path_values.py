"""Documents as (path, value) rows, one per leaf: ``.a.list.0.b``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.json_walk import LITERAL, TEXT, json_values
from docweave.functions.names import quoted
from docweave.functions.stringify import as_text, float_text


def _pair(path: Column, value: Column) -> Column:
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def _no_pairs() -> Column:
    return F.array().cast("array<struct<path:string,value:string>>")


def _pairs(value: Column, dtype: T.DataType, path: Column, nulls: bool) -> Column:
    """List of (path, value) pairs below ``value``."""

    def below(name: Column, child: Column, child_type: T.DataType) -> Column:
        return _pairs(child, child_type, F.concat(path, F.lit("."), name), nulls)

    if isinstance(dtype, T.StructType):
        parts = [below(F.lit(f.name), value.getField(f.name), f.dataType) for f in dtype.fields]
        pairs = F.concat(*parts) if parts else _no_pairs()
    elif isinstance(dtype, T.ArrayType):
        pairs = F.flatten(F.transform(value, lambda v, i: below(i.cast("string"), v, dtype.elementType)))
    elif isinstance(dtype, T.MapType):
        pairs = F.flatten(
            F.transform(
                F.map_entries(value), lambda e: below(e["key"].cast("string"), e["value"], dtype.valueType)
            )
        )
    else:
        pairs = _pair(path, as_text(value, dtype))
        if nulls:
            return pairs
    return F.when(value.isNotNull(), pairs).otherwise(_pair(path, F.lit(None)) if nulls else _no_pairs())


def path_value_rows(df: DataFrame, id_cols: Sequence[str], doc_cols: Sequence[str], null_leaves: bool = True) -> DataFrame:
    """(id columns, path, value) for each leaf of the document made of ``doc_cols``.

    Empty structs and lists give no row.  A column has a value or NULL, never "absent":
    with ``null_leaves`` every NULL gives a row.  For JSON text that leaves attributes
    out, use :func:`json_path_value_rows`.
    """
    parts = [_pairs(F.col(quoted(c)), df.schema[c].dataType, F.lit(f".{c}"), null_leaves) for c in doc_cols]
    pairs = F.concat(*parts)
    return df.select(*id_cols, F.explode(pairs).alias("__pair")).select(*id_cols, "__pair.path", "__pair.value")


def json_depth(json: Column) -> Column:
    """How deep objects and lists of a JSON text nest."""
    unescaped = F.replace(F.replace(json, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    # Every other part between quotes is outside of strings; no pattern has to match a whole string.
    outside = F.array_join(F.filter(F.split(unescaped, '"', -1), lambda _, i: i % 2 == 0), "")
    brackets = F.split(F.regexp_replace(outside, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, b: Column) -> Column:
        now = acc["now"] + F.when(b.isin("{", "["), 1).when(b.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(brackets, start, step, lambda acc: acc["most"])


def _variant_text(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "VOID", F.lit(None))
        .when(kind == "BOOLEAN", F.initcap(plain))
        .when(kind.isin("DOUBLE", "FLOAT"), float_text(F.try_variant_get(value, "$", "double")))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value))
        .otherwise(plain)
    )


def not_json(df: DataFrame, id_cols: Sequence[str], json_col: str) -> DataFrame:
    """Quarantine rows (id columns, reason, raw) for text that :func:`json_path_value_rows` cannot read."""
    text = F.col(quoted(json_col))
    return df.where(text.isNotNull() & F.try_parse_json(text).isNull()).select(
        *[F.col(quoted(c)) for c in id_cols], F.lit("not_json").alias("reason"), text.alias("raw")
    )


def json_path_value_rows(df: DataFrame, id_cols: Sequence[str], json_col: str) -> DataFrame:
    """(id columns, path, value) for each leaf of JSON text of any shape.

    One plan whatever the nesting: the text is walked in one fold over its tokens. Numbers with a fraction lose trailing
    zeros.  Text that is no JSON gives no row here; :func:`not_json` has it.
    """
    text, ids = F.col(quoted(json_col)), [F.col(quoted(c)) for c in id_cols]
    leaf = F.col("__leaf")
    leaves = F.filter(json_values(text), lambda v: v["kind"].isin(TEXT, LITERAL))
    found = df.where(F.try_parse_json(text).isNotNull()).select(*ids, F.explode(leaves).alias("__leaf"))
    value = F.when(leaf["kind"] == TEXT, leaf["text"]).otherwise(_variant_text(F.try_parse_json(leaf["text"])))
    return found.select(*ids, leaf["path"].alias("path"), value.alias("value"))
