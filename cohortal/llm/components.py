"""Connected components of an edge table, as DataFrame steps whose tables are written down."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortal.core.settle import discard

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """What runs inside loses its shuffle files when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Settles the intermediate tables of one job and gives them back together once its results are written.

    A settled table is read instead of what it was made from, so the shuffle
    files of its making go as soon as it is written.
    """

    def __init__(self, settle) -> None:
        self._settle, self._made = settle, []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        with shuffles_given_back(df.sparkSession):
            self._made.append(self._settle(df, label))
        return self._made[-1]

    def release(self, *kept: DataFrame) -> None:
        """Discard all tables but ``kept``; nothing that is still to be computed may read the others."""
        gone = [t for t in self._made if not any(t is k for k in kept)]
        self._made = [t for t in self._made if any(t is k for k in kept)]
        discard(*gone)


def components(edges: DataFrame, settle) -> DataFrame:
    """(node, label): label is the smallest node of the component. ``edges`` has a and b, long.

    Each round takes the least label of all neighbours (combined on the map
    side, so a node with many links is no burden) and then follows labels once,
    which halves the distance that is left. Rounds end when nothing changes; the
    tables of a round are given back after the next one.
    """
    keep, settle = settle, Scratch(settle)
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "cc-labels")
    last = None
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        least = settle(
            labels.join(near, labels["node"] == near["at"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-least"
        )
        ahead = least.select(F.col("node").alias("at"), F.col("label").alias("further"))
        with shuffles_given_back(edges.sparkSession):
            jumped = keep(
                least.join(ahead, least["label"] == ahead["at"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")),
                "cc-labels",
            )
        changed = jumped.where("label <> old").limit(1).count()
        settle.release(*([both] if changed else []))
        if last is not None:
            discard(last)
        labels, last = jumped.select("node", "label"), jumped
        if not changed:
            return labels
