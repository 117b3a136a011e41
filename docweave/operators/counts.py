"""Counts of a batch and the audit row made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.names import quoted
from docweave.functions.text import blank_to_default
from docweave.schemas import AUDIT


def _bounds(seq: Column, order: str) -> tuple[Column, Column]:
    if order == "lexical":
        return F.min(seq), F.max(seq)
    if order == "numeric":
        by_length = F.when(seq.isNotNull(), F.struct(F.length(seq).alias("n"), seq.alias("s")))
        return F.min(by_length)["s"], F.max(by_length)["s"]
    raise ValueError(f"order must be 'numeric' or 'lexical', not {order!r}")


def record_counts(df: DataFrame, seq: str, change_type: str | None = None, order: str = "numeric") -> DataFrame:
    """One row: I, U, D, and the least (SQ) and greatest (EQ) sequence, '0' when blank or without rows.

    Without a ``change_type`` column (values I, U, D) every row counts as an insert.
    """
    least, greatest = _bounds(F.col(quoted(seq)).cast("string"), order)
    if change_type is None:
        counts = [F.count("*").alias("I"), F.lit(0).cast("bigint").alias("U"), F.lit(0).cast("bigint").alias("D")]
    else:
        counts = [F.count_if(F.col(quoted(change_type)) == kind).alias(kind) for kind in ("I", "U", "D")]
    return df.agg(*counts, least.alias("SQ"), greatest.alias("EQ")).select(
        "I", "U", "D", blank_to_default(F.col("SQ")).alias("SQ"), blank_to_default(F.col("EQ")).alias("EQ")
    )


def audit_entry(
    counts: DataFrame, epoch_timestamp: int, source_system: str, table_name: str, status: str, log_file_name: str
) -> DataFrame:
    """The audit row of one job state."""
    return counts.select(
        F.lit(epoch_timestamp).cast("bigint").alias("epoch_timestamp"),
        F.lit(source_system).alias("source_system"),
        F.lit(table_name).alias("table_name"),
        F.lit(status).alias("status"),
        F.col("I").alias("insert_count"),
        F.col("U").alias("update_count"),
        F.col("D").alias("delete_count"),
        F.col("SQ").alias("record_start_sequence"),
        F.col("EQ").alias("record_end_sequence"),
        F.lit(log_file_name).alias("log_file_name"),
    ).select(*AUDIT.names)
