"""Running totals in sorted order over a whole table, without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import materialise

#: Columns that :func:`running_totals` uses; its input may not hold them.
PART, ROW = "__part", "__row"


def _starts(keys: pa.Array, last: str | None) -> np.ndarray:
    """True where a key differs from the one before it; ``last`` is that before the first."""
    first = np.array([keys[0].as_py() != last])
    if len(keys) == 1:
        return first
    return np.concatenate([first, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])


def _totals(group: str, values: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, {name: 0 for name in values}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group)
            starts = _starts(keys, last)
            # Where the current group began; -1 is in an earlier batch.
            began = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))
            columns = []
            for name in values:
                own = batch.column(name).to_numpy(zero_copy_only=False)
                before = np.concatenate([np.zeros(1, own.dtype), np.cumsum(own)])
                within = before[:-1] - before[np.maximum(began, 0)] + np.where(began < 0, carried[name], 0)
                carried[name] = within[-1] + own[-1]
                columns.append(pa.array(within, batch.schema.field(name).type))
            last = keys[-1].as_py()
            names = [*batch.schema.names, *[f"before_{name}" for name in values], PART]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(np.full(len(starts), part, np.int32))], names)

    return run


def stored_rows(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written with a number for each row, which is then a fact and the same at every later use."""
    return materialise(df.withColumn(ROW, F.monotonically_increasing_id()), purpose)


def running_totals(df: DataFrame, group: str, order: Sequence[Column], values: Sequence[str], purpose: str) -> DataFrame:
    """``df`` with ``before_<value>``: the sum of a value over all rows of the group that come before in ``order``.

    ``group`` is a text column without nulls, ``values`` are bigint or double columns without nulls. Rows are
    range-partitioned by group and order, so a group that holds most of the table spans many tasks. Each task adds up
    the rows it reads in their order; then every (task, group) gets what the tasks before it hold, which is a table of one
    row per task and one per group. Rows that ``order`` does not tell apart follow the number they were stored with
    (:func:`stored_rows`), so a crowd of equal rows is split too. An empty table gives an empty one.
    """
    rows = df if ROW in df.columns else stored_rows(df, f"{purpose}-rows")
    keys = [F.col(group), *order, F.col(ROW)]
    schema = T.StructType([*rows.schema.fields])
    for name in values:
        schema = schema.add(f"before_{name}", rows.schema[name].dataType)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    summed = materialise(ranged.mapInArrow(_totals(group, values), schema.add(PART, T.IntegerType())), purpose)
    parts = summed.groupBy(PART, group).agg(*[F.sum(name).alias(f"__{name}") for name in values])
    earlier = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        PART, group, *[F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}") for name in values]
    )
    joined = summed.join(materialise(offsets, f"{purpose}-offsets"), [PART, group])
    added = {f"before_{name}": F.col(f"before_{name}") + F.col(f"__{name}") for name in values}
    return joined.withColumns(added).drop(PART, ROW, *[f"__{name}" for name in values])
