"""Mutual information between numbers and classes from nearest neighbours of equal class.

For each row, d is the distance to its k-th neighbour among the rows of its
class and m the number of rows of any class nearer than d. The estimate is
psi(N) - <psi(class size)> + <psi(k)> - <psi(m)>. Neighbours are found by rank
within the class and m by ranks over all rows, so no pair of rows is formed
beyond the k before and after each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortal.core.ranks import running_totals
from cohortal.core.settle import discard, settle

NEIGHBOURS = 3


def digamma(n: Column) -> Column:
    """psi of a positive whole number: the asymptotic series at n + 6, stepped down."""
    x = n.cast("double") + 6.0
    series = F.ln(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    for k in range(6):
        series = series - 1 / (n + float(k))
    return series


def _radii(rows: DataFrame, k: int) -> DataFrame:
    """(feature, value, d, k, size, w): per class and value the distance to the k-th neighbour, and the rows that share it.

    Equal values have one distance, so a value that many rows share is one row here.
    """
    one = F.lit(1).cast("long").alias("one")
    counts = settle(rows.groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n"), F.max(one).alias("one")), "mi-counts")
    run = running_totals(counts, "value", ["n", "one"], by=["feature", "label"])
    own = settle(run.select("feature", "label", "value", "n", F.col("n_all").alias("size"), F.col("one_upto").alias("rank")), "mi-ranks")
    steps = F.array(*[F.lit(j).cast("long") for j in range(-k, k + 1)])
    offers = own.select("feature", "label", F.col("value").alias("other"), F.col("n").alias("copies"), "rank", F.explode(steps).alias("step"))
    offers = offers.select("feature", "label", "other", "copies", (F.col("rank") + F.col("step")).alias("rank"))
    met = F.struct(F.abs(F.col("value") - F.col("other")).alias("far"), (F.col("copies") - F.when(F.col("value") == F.col("other"), 1).otherwise(0)).alias("copies"))
    near = own.join(offers, ["feature", "label", "rank"]).groupBy("feature", "label", "rank", "value", "n", "size")
    found = near.agg(F.array_sort(F.collect_list(met)).alias("met"))  # at most 2k + 1 values
    used = F.least(F.lit(k), F.col("size") - 1).cast("int")
    walk = lambda a, x: F.when(a["seen"] >= used, a).otherwise(F.struct((a["seen"] + x["copies"]).alias("seen"), x["far"].alias("d")))
    d = F.aggregate("met", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("d")), walk)["d"]
    out = settle(found.select("feature", "value", d.alias("d"), used.alias("k"), "size", F.col("n").alias("w")).withColumn("id", F.monotonically_increasing_id()), "mi-radii")
    discard(counts, own)
    return out


def nearest_mi(df: DataFrame, columns: Sequence[str], label: str, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, mi): mutual information in nats, never below 0, of each column with the class.

    Rows without a value or class are left out per column, as are rows whose
    class no other row has. m counts the row itself and all rows nearer than d;
    where d is 0, because k rows of the class have the same value, it counts the
    rows with that value. Order of equal values does not matter. A column
    without usable rows has 0.
    """
    cols = list(columns)
    long = df.select(F.col(label).cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = long.where("label IS NOT NULL").unpivot(["label"], cols, "feature", "value").where("value IS NOT NULL AND NOT isnan(value)")
    sizes = long.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    rows = settle(long.join(F.broadcast(sizes), ["feature", "label"]).drop("_size"), "mi-rows")
    radii = _radii(rows, k)
    # Ends of every row's stretch and the rows themselves on one line: a running total tells how many rows lie before an end.
    zero = F.col("d") == 0
    low, high = F.col("value") - F.col("d"), F.col("value") + F.col("d")
    # Kinds order equal places: an end at 1 stands before the rows (2) there, an end at 3 behind them.
    points = rows.groupBy("feature", F.struct(F.col("value").alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("id")).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    # A row at exactly d is not nearer than d: the lower end stands behind it, the upper one before it; for d = 0 the other way round.
    ends = [
        radii.select("feature", F.struct(low.alias("at"), F.when(zero, 1).otherwise(3).alias("kind"), "id").alias("place"), F.lit(0).cast("long").alias("n")),
        radii.select("feature", F.struct(high.alias("at"), F.when(zero, 3).otherwise(1).alias("kind"), "id").alias("place"), F.lit(0).cast("long").alias("n")),
    ]
    line = settle(points.unionByName(ends[0]).unionByName(ends[1]), "mi-line")
    before = running_totals(line, "place", ["n"], by=["feature"])
    asked = before.where("place.kind <> 2").select("feature", F.col("place.id").alias("id"), "n_upto")
    inside = asked.groupBy("feature", "id").agg((F.max("n_upto") - F.min("n_upto")).alias("m"))
    each = radii.join(inside, ["feature", "id"])
    mean = lambda c, name: (F.sum(F.col("w") * digamma(c)) / F.sum("w")).alias(name)
    terms = each.groupBy("feature").agg(F.sum("w").alias("n"), mean(F.col("size"), "own"), mean(F.col("k"), "near"), mean(F.greatest("m", F.lit(1)), "all"))
    value = F.greatest(digamma(F.col("n")) - F.col("own") + F.col("near") - F.col("all"), F.lit(0.0))
    found = settle(terms.select("feature", value.alias("mi")), "mi")
    discard(rows, radii, line)
    named = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return named.join(found, "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))
