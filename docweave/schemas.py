"""Fixed schemas.  Field names are part of the data contract and must stay as they are."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(names: str, **other: T.DataType) -> T.StructType:
    """Text fields, but for those whose type is given."""
    return T.StructType([T.StructField(name, other.get(name, T.StringType())) for name in names.split()])


# The 13 bookmark columns.
BOOKMARK = _struct(
    "eventTime eventName userIdentity sourceIPAddress bucketName bucketArn fileName fileSize fileeTag sequencer "
    "sourceSystem dataLayer status",
    fileSize=T.LongType(),
)

# The ledger table: a bookmark per destination, and the queue it waits in.
LEDGER = T.StructType(
    [
        *[f for f in BOOKMARK.fields if f.name != "status"],
        *_struct("raw rule destKey reason data_layer source table status").fields,
    ]
)

# The fields of a notification.
NOTIFICATION = _struct(
    "Records",
    Records=T.ArrayType(
        _struct(
            "eventTime eventName userIdentity requestParameters s3",
            userIdentity=_struct("principalId"),
            requestParameters=_struct("sourceIPAddress"),
            s3=_struct(
                "bucket object",
                bucket=_struct("name arn"),
                object=_struct("key size eTag sequencer", size=T.LongType()),
            ),
        )
    ),
)

# The 10 audit columns, and the columns that identify one audit row.
AUDIT = _struct(
    "epoch_timestamp source_system table_name status insert_count update_count delete_count record_start_sequence "
    "record_end_sequence log_file_name",
    epoch_timestamp=T.LongType(),
    insert_count=T.LongType(),
    update_count=T.LongType(),
    delete_count=T.LongType(),
)
AUDIT_KEYS = ["epoch_timestamp", "source_system", "table_name"]

# What could not be loaded: why, the text, where it came from, when, and the partitions.
QUARANTINE = _struct(
    "reason raw source_file loaded_at source_system table_name year month day", loaded_at=T.TimestampType()
)

CORRUPT = "_corrupt_record"


def feed_schema(image: T.StructType, keys: T.StructType | None = None) -> T.StructType:
    """Schema of a change-feed file whose documents have the given typed ``image``."""
    change = [T.StructField("SequenceNumber", T.StringType())]
    if keys is not None:
        change.append(T.StructField("Keys", keys))
    change.append(T.StructField("NewImage", image))
    record = _struct("eventName dynamodb", dynamodb=T.StructType(change))
    return _struct("Records", Records=T.ArrayType(record))


def with_corrupt(schema: T.StructType) -> T.StructType:
    """``schema`` plus the column in which Spark keeps text it could not parse."""
    if CORRUPT in schema.names:
        return schema
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
