"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around that node."""
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    return (
        both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them."""
    down = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    moved = down.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(least.select("src", F.col("least").alias("dst")))


def _state(links: DataFrame) -> tuple:
    """Number and checksum of a set of links: two longs, whatever the size of the set."""
    row = links.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("src", "dst"), 20)), F.bit_xor(F.xxhash64("src", "dst"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached, for every node of ``links(src, dst)``.

    Self-links, repeated links and nulls in ``links`` have no effect beyond naming a node.
    Each round is written to the shared folder. The number of rounds grows with the logarithm of
    the longest chain, and no task sees more than a share of a hot node's links: minima are
    combined before the shuffle, and the joins have no other shuffle above them that would keep
    adaptive execution from splitting a hot key.
    """
    given = links.where("src is not null and dst is not null")
    links = materialise(given.where("src <> dst").select("src", "dst").distinct(), "links")
    state = _state(links)
    while state[0]:
        links = materialise(_small_star(_large_star(links).distinct()).distinct(), "links")
        previous, state = state, _state(links)
        if state == previous:
            break
    roots = links.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    return links.toDF("node", "component").union(roots).distinct()
