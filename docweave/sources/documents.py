"""Documents: parquet snapshots and change-feed files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.json_walk import ANY, ARRAY, MAP, OBJECT, TEXT, misfits
from docweave.schemas import CORRUPT, feed_schema, with_corrupt
from docweave.sources.files import entries, literal, numbers

# Feed event names and the change types they stand for.
CHANGE_TYPES = {"INSERT": "I", "MODIFY": "U", "REMOVE": "D"}

FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def case_sensitive(spark: SparkSession):
    """Attributes that differ only in case stay apart while plans are built inside this block."""
    return setting(spark, "spark.sql.caseSensitive", "true")


#: Documents that nest deeper are run without a search for common parts of expressions, whose time doubles with every level.
DEEP = 8


def nesting(dtype: T.DataType) -> int:
    """How deep structs nest."""
    if isinstance(dtype, T.StructType):
        return 1 + max((nesting(f.dataType) for f in dtype.fields), default=0)
    if isinstance(dtype, T.ArrayType):
        return nesting(dtype.elementType)
    return nesting(dtype.valueType) if isinstance(dtype, T.MapType) else 0


def plan_setting(spark: SparkSession, document: T.DataType):
    """The setting under which a plan over typed documents of this type is to be run: a block, like :func:`case_sensitive`."""
    name = "spark.sql.subexpressionElimination.enabled"
    # Each level of a document is a struct of tags in a struct of attributes.
    return setting(spark, name, "false" if nesting(document) > 2 * DEEP else spark.conf.get(name))


def scan_snapshot(spark: SparkSession, paths: str | list[str], merge_schema: bool = True) -> DataFrame:
    """All parquet files of a full load as one table."""
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def infer_feed_schema(spark: SparkSession, paths: str | list[str], multiline: bool = True) -> T.StructType:
    """Schema over *all* records of the given files, in one extra pass.

    Parts that every feed has are there even if no file shows them, as in files that only
    hold removals.
    """
    reader = spark.read.option("multiLine", multiline).option("primitivesAsString", "true")
    found = _struct_at(reader.json(_literal(paths)).schema, "Records", "dynamodb")
    parts = {f.name: f.dataType for f in found.fields}
    keys, image = parts.get("Keys"), parts.get("NewImage")
    return feed_schema(
        image if isinstance(image, T.StructType) else T.StructType([]),
        keys if isinstance(keys, T.StructType) else None,
    )


def _struct_at(dtype: T.DataType, *names: str) -> T.StructType:
    """The struct below ``dtype`` at a path through structs and lists, without fields if there is none."""
    for name in names:
        dtype = dtype[name].dataType if isinstance(dtype, T.StructType) and name in dtype.names else dtype
        dtype = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
        if not isinstance(dtype, T.StructType):
            return T.StructType([])
    return dtype


def _literal(paths: str | list[str]) -> list[str]:
    return [literal(path) for path in ([paths] if isinstance(paths, str) else paths)]


def read_feed(spark: SparkSession, paths: str | list[str], schema: T.StructType, multiline: bool = True) -> DataFrame:
    """Parsed feed files: ``Records``, the text that did not parse, and the file.

    ``schema`` has to be that of these very files; for one that is known beforehand see :func:`read_known_feed`.
    """
    return _with_file(spark.read.schema(with_corrupt(schema)).option("multiLine", multiline).json(_literal(paths)))


def read_known_feed(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, multiline: bool = True
) -> DataFrame:
    """The same with documents as their JSON text, to be parsed under a schema known beforehand by :func:`feed_records`."""
    return read_feed(spark, paths, images_as_text(schema), multiline)


def stream_feed(
    spark: SparkSession, folder: str, schema: T.StructType, multiline: bool = True, max_files: int | None = None
) -> DataFrame:
    """:func:`read_known_feed` as a stream of the files that arrive in ``folder``."""
    reader = spark.readStream.schema(with_corrupt(images_as_text(schema))).option("multiLine", multiline)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_file(reader.json(folder))


def widened(known: T.DataType, found: T.DataType, as_text: bool = False) -> T.DataType:
    """A type that has a place for what either has.

    Text may mean that no value was seen but null or an empty list; it gives way to structs and lists, and only ``as_text``
    has both become JSON text. Other types that do not fit become text too.
    """
    if isinstance(known, T.NullType) or known == found:
        return found
    if isinstance(found, T.NullType):
        return known
    if isinstance(known, T.StructType) and isinstance(found, T.StructType):
        new = {f.name: f.dataType for f in found.fields}
        both = [T.StructField(f.name, widened(f.dataType, new.pop(f.name, f.dataType), as_text)) for f in known.fields]
        return T.StructType([*both, *[T.StructField(name, dtype) for name, dtype in new.items()]])
    if isinstance(known, T.ArrayType) and isinstance(found, T.ArrayType):
        return T.ArrayType(widened(known.elementType, found.elementType, as_text))
    for text, other in ((known, found), (found, known)):
        if isinstance(text, T.StringType) and isinstance(other, (T.StructType, T.ArrayType)) and not as_text:
            return other
    return T.StringType()


#: The folder beside a table in which the schema of its feed is kept.
SCHEMA_FOLDER = "_schema"


def kept_schema(spark: SparkSession, root: str) -> T.StructType | None:
    """The schema that the feed of a table had so far; None if none is kept."""
    noted = numbers(entries(spark, f"{root}/{SCHEMA_FOLDER}"))
    if not noted:
        return None
    text = spark.read.schema("schema string").parquet(f"{root}/{SCHEMA_FOLDER}/batch_id={noted[-1]}").first()[0]
    return T.StructType.fromJson(json.loads(text))


def keep_schema(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """Keep a schema beside a table, above those that were kept before."""
    noted = numbers(entries(spark, f"{root}/{SCHEMA_FOLDER}"))
    row = spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1)
    row.write.mode("overwrite").parquet(f"{root}/{SCHEMA_FOLDER}/batch_id={noted[-1] + 1 if noted else 0}")


def _image_type(schema: T.StructType) -> T.StructType:
    return schema["Records"].dataType.elementType["dynamodb"].dataType["NewImage"].dataType


def _keys_type(schema: T.StructType) -> T.StructType | None:
    change = schema["Records"].dataType.elementType["dynamodb"].dataType
    return change["Keys"].dataType if "Keys" in change.names else None


def images_as_text(schema: T.StructType) -> T.StructType:
    """``schema`` with documents, and the keys of what was removed, as their JSON text."""
    record = schema["Records"].dataType.elementType
    texts = [T.StructField(name, T.StringType()) for name in ("Keys", "NewImage")]
    change = [f for f in record["dynamodb"].dataType if f.name not in ("Keys", "NewImage")] + texts
    fields = [T.StructField(f.name, T.StructType(change) if f.name == "dynamodb" else f.dataType) for f in record]
    return T.StructType([T.StructField("Records", T.ArrayType(T.StructType(fields)))])


def with_null_tags(schema: T.StructType) -> T.StructType:
    """A feed's schema in which every value may be null: which of them were, says nothing of those to come."""

    def value(dtype: T.DataType) -> T.DataType:
        if not isinstance(dtype, T.StructType):
            return dtype
        tags = []
        for tag in dtype.fields:
            inside = tag.dataType
            if tag.name == "M" and isinstance(inside, T.StructType):
                inside = attributes(inside)
            elif tag.name == "L" and isinstance(inside, T.ArrayType):
                inside = T.ArrayType(value(inside.elementType))
            tags.append(T.StructField(tag.name, inside))
        return T.StructType(tags if "NULL" in dtype.names else [*tags, T.StructField("NULL", T.StringType())])

    def attributes(dtype: T.StructType) -> T.StructType:
        return T.StructType([T.StructField(f.name, value(f.dataType)) for f in dtype.fields])

    return feed_schema(attributes(_image_type(schema)), _keys_type(schema))


def _names_in(value: Column, dtype: T.DataType) -> Column:
    """How many attribute names a parsed value holds, at all levels."""
    if isinstance(dtype, T.StructType):
        parts = [F.when(value[f.name].isNotNull(), _names_in(value[f.name], f.dataType) + 1).otherwise(0) for f in dtype.fields]
        return sum(parts, F.lit(0))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.aggregate(value, F.lit(0), lambda n, v: n + F.coalesce(_names_in(v, dtype.elementType), F.lit(0)))
    if isinstance(dtype, T.MapType):
        start = F.size(value)
        return F.aggregate(F.map_values(value), start, lambda n, v: n + F.coalesce(_names_in(v, dtype.valueType), F.lit(0)))
    return F.lit(0)


def all_parsed(text: Column, value: Column, dtype: T.DataType) -> Column:
    """True only where every attribute name of a document's text came out as a value that is not null.

    Text that the reader passes on has no space before a colon, so each name ends in ``":``. Inside a string a quote is
    escaped, and with escaped backslashes out of the way such a place is one more with ``\\":``.
    """
    plain = F.replace(text, F.lit("\\\\"), F.lit(""))
    # Lengths in bytes are known, those in characters would have to be counted.
    names = (F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit('":'), F.lit("")))) / 2
    inside = (F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit('\\":'), F.lit("")))) / 3
    return names - inside == _names_in(value, dtype)


def shape(dtype: T.DataType, path: str = "") -> dict[str, str]:
    """The kinds of values for which a type has a place, by their paths; see :func:`misfits`."""
    if isinstance(dtype, T.StructType):
        found = {path: OBJECT}
        for field in dtype.fields:
            found |= shape(field.dataType, f"{path}.{field.name.replace('.', chr(92) + '.')}")
        return found
    if isinstance(dtype, T.MapType):
        return {path: MAP} | shape(dtype.valueType, f"{path}.*")
    if isinstance(dtype, T.ArrayType):
        return {path: ARRAY} | shape(dtype.elementType, f"{path}.*")
    return {path: ANY if isinstance(dtype, T.StringType) else TEXT}


def uncovered(json: Column, parsed: Column, dtype: T.DataType) -> Column:
    """True where JSON text holds an attribute, a type tag or a shape that ``dtype`` has no place for.

    ``parsed`` is what came of the text; only if it has fewer names than the text is the text walked.
    """
    walked = F.coalesce(misfits(json, shape(dtype)) | parsed.isNull(), F.lit(False))
    return json.isNotNull() & (json != "null") & ~F.coalesce(all_parsed(json, parsed, dtype), F.lit(False)) & walked


def stream_paths(spark: SparkSession, folder: str, max_files: int) -> DataFrame:
    """Paths of the files that arrive in ``folder``, as a stream; no content is read."""
    reader = spark.readStream.format("binaryFile").schema(FILE)
    return reader.option("maxFilesPerTrigger", max_files).load(folder).select("path")


def _with_file(rows: DataFrame) -> DataFrame:
    return rows.select("Records", CORRUPT, F.col("_metadata.file_path").alias("source_file"))


#: A number of each record of a feed, its own within a job.
DELIVERY = "delivery"


def feed_records(
    files: DataFrame, schema: T.StructType | None = None, delivery: bool = False, whole: bool = True
) -> DataFrame:
    """One row per change: change_type (I, U, D), Sequence_No, image, and keys when the feed has them.

    A REMOVE has no image; it comes through as a row of type D. Files that parse in part only give no
    rows: see :func:`unparsed`. Documents that come as text are parsed under ``schema``, which was known beforehand;
    ``uncovered`` then holds the text of those that the schema does not cover. Unless ``whole``, there is ``doubtful`` in its
    place, which costs little: false where all names of a document came out as values. With ``delivery`` every record gets
    a number, which also keeps conditions on documents from being put where they would have to be parsed for them.
    """
    record = F.col("record")
    element = files.schema["Records"].dataType.elementType
    change = element["dynamodb"].dataType
    carried = [c for c in files.columns if c not in ("Records", CORRUPT)]
    if CORRUPT in files.columns:
        files = files.where(F.col(CORRUPT).isNull())
    names = F.create_map(*[F.lit(x) for pair in CHANGE_TYPES.items() for x in pair])
    columns = [
        F.coalesce(
            names[record["eventName"]], F.when(record["dynamodb"]["NewImage"].isNull(), F.lit("D")).otherwise("U")
        ).alias("change_type"),
        record["dynamodb"]["SequenceNumber"].alias("Sequence_No"),
        record["dynamodb"]["NewImage"].alias("image"),
    ]
    if "Keys" in change.names:
        columns.append(record["dynamodb"]["Keys"].alias("keys" if schema is None else "__keys"))
    numbered = [F.monotonically_increasing_id().alias(DELIVERY)] if delivery else []
    records = files.select(*carried, F.explode("Records").alias("record"))
    if schema is None:
        return records.select(*carried, *columns, *numbered)
    records = records.select(*carried, *columns)
    image, text = _image_type(schema), F.col("__text")
    names = [c for c in records.columns if c != "image"]
    # The parsed document is a column of its own, so that it is parsed once for its values and for what it lacks.
    parsed = [F.col("image").alias("__text"), F.from_json("image", image).alias("image")]
    keys_type = _keys_type(schema)
    if keys_type is not None:
        parsed.append(F.from_json("__keys", keys_type).alias("keys"))
    records = records.select(*names, *parsed, *numbered)
    if whole:
        records = records.withColumn("uncovered", F.when(uncovered(text, F.col("image"), image), text))
        return records.drop("__text", "__keys")
    doubtful = text.isNotNull() & ~F.coalesce(all_parsed(text, F.col("image"), image), F.lit(False))
    # Of a removal the keys are all there is.
    lost = F.lit(True) if keys_type is None else ~F.coalesce(all_parsed(F.col("__keys"), F.col("keys"), keys_type), F.lit(False))
    doubtful = doubtful | ((F.col("change_type") == "D") & F.col("__keys").isNotNull() & lost)
    return records.withColumn("doubtful", doubtful).drop("__text", "__keys")


def unparsed(files: DataFrame) -> DataFrame:
    """Quarantine rows for text that is not JSON or only in part, or is JSON without a list of records."""
    return files.where(F.col("Records").isNull() | F.col(CORRUPT).isNotNull()).select(
        F.lit("unparsed").alias("reason"), F.col(CORRUPT).alias("raw"), "source_file"
    )


def scan_change_feed(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None, multiline: bool = True
) -> DataFrame:
    """Change records of all files, under a schema known beforehand or the one found from all of them first.

    Newline-delimited files (``multiline=False``) are splittable.
    """
    if schema is None:
        return feed_records(read_feed(spark, paths, infer_feed_schema(spark, paths, multiline), multiline))
    return feed_records(read_known_feed(spark, paths, schema, multiline), schema)
