"""Joins that survive a key holding a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.sources.documents import setting
from docweave.workspace import CLEANUP, shared_folder

# Result rows of one key that one task is given.
ROWS_PER_TASK = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def salted_keys(weights: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys that give more than ``rows_per_task`` rows, and among how many salts (``__salts``) each is dealt.

    ``weights`` is read once, by writing the answer to the shared folder.  There are fewer such keys
    than the result has tasks.
    """
    salts = F.ceil(F.col("__weight") / rows_per_task).cast("int")
    path = shared_folder(weights.sparkSession, "hot-keys")
    hot = weights.where(F.col("__weight") > rows_per_task).select(*keys, salts.alias("__salts"))
    with setting(weights.sparkSession, CLEANUP, "true"):
        hot.write.parquet(path)
    return weights.sparkSession.read.schema(hot.schema).parquet(path)


def left_join_children(
    base: DataFrame,
    children: Sequence[DataFrame],
    keys: Sequence[str],
    weights: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``base`` left-joined with each child on ``keys``, NULL matching NULL.

    ``weights`` says how many rows each key will give (``keys`` and ``__weight``).  Rows of a key that gives many are
    dealt to as many salts as it needs tasks, by a hash of their content (the same on every retry), and the
    children of that key are copied to each salt, so a task gets about ``rows_per_task`` rows of it
    whatever the share of the key.  All joins use the same columns: base is shuffled once.  Without
    such keys the joins are plain.
    """

    def matched(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
        condition = F.lit(True)
        for name in names:
            condition = condition & left[name].eqNullSafe(right[prefix + name])
        return left.join(right, condition, "left").drop(*[prefix + name for name in names])

    def prefixed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(prefix + c) if c in names else F.col(c) for c in df.columns])

    hot = salted_keys(weights, keys, rows_per_task)
    if hot.isEmpty():
        for child in children:
            base = matched(base, prefixed(child, keys, "__r_"), keys, "__r_")
        return base
    hot = prefixed(hot, keys, "__hot_")
    deal = F.pmod(F.xxhash64(*base.columns), F.col("__salts")).cast("int")
    joined = matched(base, hot, keys, "__hot_").withColumn("__salt", F.coalesce(deal, F.lit(0))).drop("__salts")
    on = [*keys, "__salt"]
    for child in children:
        copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
        right = matched(child, hot, keys, "__hot_").withColumn("__salt", F.explode(copies)).drop("__salts")
        joined = matched(joined, prefixed(right, on, "__r_"), on, "__r_")
    return joined.drop("__salt")
