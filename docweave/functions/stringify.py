"""Values as text, the way a wide all-string table stores them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.clock import epoch_millis
from docweave.functions.names import quoted

# Fixed value: digits a snapshot float keeps after the point.
SNAPSHOT_DIGITS = 10

# Text of a float that is shorter than this has its shortest form.
LONG_TEXT = 18


def _apart(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` as a lambda, whose code stays out of the compiled row loop.

    The JVM does not optimise a loop of more than 8000 bytes, and the rarely needed parts
    of several floats make it longer than that.
    """
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _long_float_text(value: Column) -> Column:
    """Text of a float whose Java text is long or has an exponent.

    A long text may have a digit too many: 16 and 17 digits are tried then.
    """
    java, size = value.cast("string"), F.abs(value)
    sixteen, seventeen = F.format_string("%.15e", value), F.format_string("%.16e", value)
    digits = F.lower(
        F.when(F.length(java) < LONG_TEXT, java)
        .when(sixteen.try_cast("double") == value, sixteen)
        .when(seventeen.try_cast("double") == value, seventeen)
        .otherwise(java)
    )
    # 17 digits before the point and 21 after hold every float of the plain range.
    plain = F.regexp_replace(digits.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.regexp_replace(plain, r"\.$", ".0")
    exponent = F.regexp_replace(F.replace(digits, F.lit("e+"), F.lit("e")), r"\.?0+e", "e")
    exponent = F.regexp_replace(F.regexp_replace(exponent, r"e(-?)(\d)$", "e$10$2"), r"e(\d)", "e+$1")
    return F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(exponent)


def float_text(value: Column, java: Column | None = None, apart: bool = False) -> Column:
    """Shortest text of a float: plain from 1e-4 up to 1e16, with an exponent beyond; NaN is missing.

    ``java`` is Spark's own text of ``value`` when the caller has it.  That text is final
    when it is short and has no exponent; the other case is the rare one.
    """
    java = value.cast("string") if java is None else java
    return (
        F.when(F.isnan(value), F.lit(None))
        .when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((F.length(java) < LONG_TEXT) & ~java.contains("E"), java)
        .otherwise(_apart(value, _long_float_text) if apart else _long_float_text(value))
    )


def _rounded(value: Column) -> Column:
    """The part after the point is scaled and rounded as a float; rounding the decimal digits
    instead would differ where they end in 5."""
    size = F.abs(value)
    whole = F.floor(size)
    scaled = (size - whole) * 10.0**SNAPSHOT_DIGITS
    down = F.floor(scaled)
    rest = scaled - down
    up = (rest > 0.5) | ((rest == 0.5) & ((down == 0) | (down % 2 == 1)))
    parts = down + F.when(up, 1).otherwise(0)
    carried = F.when(parts >= 10**SNAPSHOT_DIGITS, whole + 1).otherwise(whole)
    parts = F.when(parts >= 10**SNAPSHOT_DIGITS, 0).otherwise(parts)
    text = F.concat(carried.cast("string"), F.lit("."), F.lpad(parts.cast("string"), SNAPSHOT_DIGITS, "0"))
    return F.when(value < 0, -text.cast("double")).otherwise(text.cast("double"))


def snapshot_float(value: Column, java: Column | None = None, apart: bool = False) -> Column:
    """``value`` as it comes back from JSON text with ten digits after the point."""
    java = value.cast("string") if java is None else java
    few_digits = (F.length(java) - F.locate(".", java) <= SNAPSHOT_DIGITS) & ~java.contains("E")
    return F.when(few_digits | F.isnan(value) | (F.abs(value) >= 1e15), value).otherwise(
        _apart(value, _rounded) if apart else _rounded(value)
    )


def as_double(value: Column, dtype: T.DataType) -> Column:
    """A number as a double; a 32-bit float keeps its own short digits."""
    return value.cast("string").cast("double") if isinstance(dtype, T.FloatType) else value.cast("double")


def as_text(value: Column, dtype: T.DataType, snapshot: bool = False) -> Column:
    """Text of ``value``; NULL stays NULL.

    ``snapshot`` gives the forms of a row that went through JSON: instants as epoch
    milliseconds, floats cut to ten digits, decimals as floats.
    """
    match dtype:
        case T.StringType() | T.CharType() | T.VarcharType():
            return value
        case T.NullType():
            return F.lit(None).cast("string")
        case T.BooleanType():
            return F.when(value, F.lit("True")).when(~value, F.lit("False"))
        case T.FloatType() | T.DoubleType():
            value = as_double(value, dtype)
            return float_text(snapshot_float(value) if snapshot else value)
        case T.DecimalType() if snapshot:
            return float_text(snapshot_float(value.cast("double")))
        case T.TimestampType() if snapshot:
            return F.unix_millis(value).cast("string")
        case T.TimestampNTZType() if snapshot:
            return epoch_millis(value).cast("string")
        case T.DateType() if snapshot:
            return (F.unix_date(value).cast("long") * 86_400_000).cast("string")
        case T.BinaryType():
            return F.base64(value)
        case T.StructType() | T.ArrayType() | T.MapType() | T.VariantType():
            return F.to_json(value)
        case _:
            return value.cast("string")


def fill_blank(df: DataFrame, fill: str = "") -> DataFrame:
    """NULL becomes ``fill`` in every string column."""
    return df.select(
        *[
            F.coalesce(F.col(quoted(f.name)), F.lit(fill)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(quoted(f.name))
            for f in df.schema.fields
        ]
    )


def with_text(
    df: DataFrame,
    values: Sequence[tuple[str, Column, T.DataType]],
    keep: Sequence[str] = (),
    fill: str | None = "",
    snapshot: bool = False,
) -> DataFrame:
    """``df``'s columns ``keep``, and each (name, value, type) as text; NULL becomes ``fill`` unless that is None.

    Floats need several steps that each use the result of the one before more than once;
    every step is a projection of its own, so that no value is computed twice.
    """
    fractions = {
        i: as_double(value, dtype)
        for i, (_, value, dtype) in enumerate(values)
        if isinstance(dtype, (T.FloatType, T.DoubleType)) or (snapshot and isinstance(dtype, T.DecimalType))
    }
    apart = snapshot or len(fractions) > 1
    kept = [F.col(quoted(c)) for c in keep]
    texts = {i: as_text(value, dtype, snapshot) for i, (_, value, dtype) in enumerate(values) if i not in fractions}
    if fractions:
        done = [text.alias(f"__text{i}") for i, text in texts.items()]
        texts = {i: F.col(f"__text{i}") for i in texts}
        rest = [*kept, *texts.values()]
        df = df.select(*kept, *done, *[value.alias(f"__value{i}") for i, value in fractions.items()])
        numbers = {i: F.col(f"__value{i}") for i in fractions}

        def with_java(df: DataFrame) -> DataFrame:
            return df.select(
                *rest, *numbers.values(), *[n.cast("string").alias(f"__java{i}") for i, n in numbers.items()]
            )

        if snapshot:
            df = with_java(df)
            df = df.select(
                *rest, *[snapshot_float(n, F.col(f"__java{i}"), apart).alias(f"__value{i}") for i, n in numbers.items()]
            )
        df = with_java(df)
        texts |= {i: float_text(n, F.col(f"__java{i}"), apart) for i, n in numbers.items()}
    return df.select(
        *kept,
        *[
            (texts[i] if fill is None else F.coalesce(texts[i], F.lit(fill))).alias(name)
            for i, (name, _, _) in enumerate(values)
        ],
    )


def stringify(df: DataFrame, fill: str | None = "", snapshot: bool = False) -> DataFrame:
    """Every column as text, NULL as ``fill`` (kept when ``fill`` is None)."""
    return with_text(df, [(f.name, F.col(quoted(f.name)), f.dataType) for f in df.schema.fields], (), fill, snapshot)


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object: instants as epoch milliseconds, floats cut to ten digits, NULLs kept."""
    fields = []
    for field in df.schema.fields:
        column = F.col(quoted(field.name))
        match field.dataType:
            case T.TimestampType():
                column = F.unix_millis(column)
            case T.TimestampNTZType():
                column = epoch_millis(column)
            case T.DateType():
                column = F.unix_date(column).cast("long") * 86_400_000
            case T.FloatType() | T.DoubleType() | T.DecimalType():
                column = snapshot_float(column.cast("double"))
        fields.append(column.alias(field.name))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))
