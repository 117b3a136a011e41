"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget of words by weight, each up to ``most`` times its own size. A document's key is exponential,
with its quality weight as the rate, so the documents with the least keys are a weighted sample without
replacement. Whole epochs over a source come first; what its target has beyond them is filled in the order of the
keys, by a prefix sum of sizes, and the document at the end of the budget gives the words that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.names import quoted
from docweave.llm.common import materialise
from docweave.llm.running import running_totals, stored_rows

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has so many times the words of all sources, and at most so many times those of one.
SHARE, MOST = 1.5, 2
#: Documents labelled good are this many times as likely to come early as those labelled poor; those without a label are
#: in the middle.
GOOD_TO_POOR = 4.0

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a document's random number, as many as a double holds.
BITS = 52


def sizes(text: Column) -> Column:
    """Words of a text, none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_bits(columns: Sequence[Column]) -> Column:
    """A number of ``BITS`` bits, from the content alone."""
    whole = F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c)) for c in columns])
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("bigint")


def exponential_key(bits: Column, weight: Column) -> Column:
    """Least first; a weight that is not above zero comes after all others."""
    uniform = (bits + 1).cast("double") / float(1 << BITS)
    return F.when(weight > 0, -F.log(uniform) / weight).otherwise(F.lit(float("inf")))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight of labelled documents; an id that is labelled several times has the mean of its labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id")
    return known.agg(F.avg("quality").alias("quality")).select(
        "doc_id", F.pow(F.lit(GOOD_TO_POOR), F.col("quality") - 0.5).alias("weight")
    )


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, target of every source of ``sized(source, size)``; a null source is one, and the last.

    Filling the sources by weight, one is full when the level reaches ``most * size / weight``. With sources in this order
    a prefix sum tells how much all of them hold at that level, and so which are full when the budget is used up; the others
    share the rest by weight. Only four sums come to the driver, however many sources there are.
    """
    held = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    held = held.select("source", "source_size", F.lit("").alias("all"), F.lit(1).cast("bigint").alias("one"))
    ranked = running_totals(held, "all", [F.col("source").asc_nulls_last()], ["one"], "source-ranks")
    turn = (F.col("before_one") % len(weights) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
    full = F.col("source_size") * F.lit(float(most))
    levels = ranked.select("all", "source", "source_size", weight.alias("weight"), full.alias("full"), (full / weight).alias("level"))
    filled = materialise(running_totals(levels, "all", [F.col("level"), F.col("source")], ["full", "weight"], "source-levels"), "source-levels")
    total = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, all_weight = share * (total[0] or 0), total[1] or 0.0
    above = F.lit(all_weight) - F.col("before_weight") - F.col("weight")
    is_full = F.col("before_full") + F.col("full") + F.col("level") * above <= F.lit(float(budget))
    left = filled.agg(F.sum(F.when(is_full, F.col("full"))), F.sum(F.when(~is_full, F.col("weight")))).first()
    level = (budget - (left[0] or 0.0)) / left[1] if left[1] else 0.0
    target = F.when(is_full, F.col("full")).otherwise(F.col("weight") * F.lit(float(level)))
    return filled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, epochs, part, taken, and the ``carry`` columns, for every row of ``docs``.

    A document is taken ``epochs`` times as a whole, and then its first ``part`` words (all, some or none); ``taken`` is
    the number of words of both. ``quality(doc_id, weight)`` has one row for an id; other documents weigh 1, as does a null
    weight. A source's words add up to its target, rounded. The same rows give the same mix, however they are stored.

    A null source is a source of its own. Null and empty texts have no words and give none. Repeated rows have one key and
    stand beside each other. An empty table gives an empty mix. Columns that are not named are not read.
    """
    name = F.col("source")
    rows = docs.select(
        "doc_id",
        name.alias("source"),
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("group"),
        sizes(F.col("text")).alias("size"),
        random_bits([F.col("doc_id"), name, F.col("text")]).alias("bits"),
        *[F.col(quoted(c)).alias(f"carry_{c}") for c in carry],
    )
    sized = stored_rows(rows, "mix-sizes")
    targets = materialise(source_targets(sized, weights, share, most), "mix-targets").withColumnRenamed("source", "of")
    planned = sized.join(targets, sized["source"].eqNullSafe(targets["of"]))
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    planned = planned.withColumn("budget", budget)
    planned = planned.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    planned = planned.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("of", "budget", "source")
    if quality is None:
        weighted = planned.withColumn("weight", F.lit(1.0))
    else:
        stored = materialise(quality.select(F.col("doc_id").alias("id"), "weight"), "mix-weights")
        weighted = planned.join(stored, planned["doc_id"] == stored["id"], "left").drop("id")
    key = exponential_key(F.col("bits"), F.coalesce(F.col("weight"), F.lit(1.0)))
    # A source that is done after its epochs needs no order.
    sampled = weighted.where("rest > 0").withColumn("key", key).drop("weight")
    order = [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("bits")]
    sampled = running_totals(sampled, "group", order, ["size"], "mix-order")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before_size")))
    kept = ["doc_id", "size", "source_size", "target", "epochs", "part", *[f"carry_{c}" for c in carry]]
    both = sampled.withColumn("part", part).select(*[F.col(quoted(c)) for c in kept]).unionByName(
        planned.where("rest = 0").withColumn("part", F.lit(0).cast("bigint")).select(*[F.col(quoted(c)) for c in kept])
    )
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return both.withColumn("taken", taken).withColumnsRenamed({f"carry_{c}": c for c in carry})


def mixed_texts(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The mix itself: doc_id, epoch (from 1), text. Of the document at the end of a source's budget the first words, a space between them."""
    plan = mix(docs, quality, carry=["text"], **options).where("taken > 0")
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    cut = F.when(F.col("part") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("part").cast("int")), " "))
    last = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = plan.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), last)))
    return rows.select("doc_id", "epoch", F.when(F.col("epoch") <= F.col("epochs"), F.col("text")).otherwise(cut).alias("text"))
