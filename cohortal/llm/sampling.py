"""A bounded sample of labelled rows, lowest hashes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_CELLS = 1_000_000


def bounded_sample(rows: DataFrame, group: str, per_group: int, order: Column, most_groups: int) -> DataFrame:
    """At most ``per_group`` rows of each of the ``most_groups`` largest groups.

    A first filter by hash leaves about twice that many of a large group, so
    that no group is ever gathered whole. Null groups are left out.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    sizes = {r[group]: r["n"] for r in counts.orderBy(F.desc("n"), group).limit(most_groups).collect()}
    if not sizes:
        return rows.limit(0)
    share = None
    for name, n in sizes.items():
        kept = F.lit(_CELLS if n <= 2 * per_group else int(_CELLS * 2 * per_group / n) + 50)
        share = F.when(F.col(group) == name, kept) if share is None else share.when(F.col(group) == name, kept)
    cell = F.pmod(F.xxhash64(order), F.lit(_CELLS))
    near = rows.withColumns({"_cell": cell, "_order": F.xxhash64(order)}).where(F.col("_cell") < share)
    place = F.row_number().over(W.partitionBy(group).orderBy("_cell", "_order"))
    return near.withColumn("_place", place).where(F.col("_place") <= per_group).drop("_cell", "_order", "_place")
