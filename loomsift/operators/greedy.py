"""Order-dependent dedup in parallel: who survives when each row falls to a surviving earlier neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.functions.store import checkpointed


def fallen(edges: DataFrame) -> DataFrame:
    """``j``: the rows that a scan in order drops, given ``i, j`` with i before j for each pair of similar rows.

    A row is dropped if a surviving earlier row is similar to it: the lexicographically first maximal independent set.
    Each round keeps the undecided rows without an undecided earlier neighbour and drops their later neighbours.
    """
    left = checkpointed(edges.select("i", "j").where("i < j").distinct())
    out = None
    while not left.isEmpty():
        heads = left.select(F.col("i").alias("k")).distinct().join(left.select(F.col("j").alias("k")), "k", "left_anti")
        dropped = checkpointed(left.join(heads, left.i == heads.k, "left_semi").select("j").distinct())
        out = dropped if out is None else out.unionByName(dropped)
        gone_i, gone_j = dropped.withColumnRenamed("j", "i"), dropped
        # edges of dropped rows no longer matter; those of kept rows are done with
        left = checkpointed(left.join(gone_i, "i", "left_anti").join(gone_j, "j", "left_anti"))
    return left.select("j") if out is None else out
