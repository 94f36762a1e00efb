"""Ordered target statistics against a walk over the rows in order."""

import random

import pytest
from pyspark.sql import functions as F

from cohortal.core.keys import sample_key
from cohortal.operators.target_stats import fit_encoder, load_encoder, ordered_stats

SCHEMA = "row_id long, a string, b int, y double"


def made(seed, n=200):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "x", "x", "y", None, f"v{i}"]), rng.randrange(4), None if rng.random() < 0.1 else float(rng.random() < 0.4)) for i in range(n)]
    return rows + [(3, rows[3][1], rows[3][2], 1.0), (3, "other", 9, 0.0)]


def walked(spark, rows, column, prior, strength):
    """Statistic of every (id, value) from the rows of smaller key."""
    ids = spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "row_id long")
    keys = {r.row_id: r.k for r in ids.select("row_id", sample_key("row_id").alias("k")).collect()}
    out = {}
    for r in rows:
        before = [s for s in rows if s[column] == r[column] and (keys[s[0]], s[0]) < (keys[r[0]], r[0]) and s[3] is not None]
        out[r[0], r[column]] = (sum(s[3] for s in before) + prior * strength) / (len(before) + strength)
    return out


@pytest.mark.parametrize("large", [False, True])
def test_statistics_equal_a_walk_in_order(spark, request, large):
    if large:
        request.getfixturevalue("large_paths")
        request.getfixturevalue("many_slices")
    rows = made(1)
    out = ordered_stats(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "y", prior=0.3, strength=2.0).collect()
    assert len(out) == len(rows)
    for k, name in ((1, "a"), (2, "b")):
        expected = walked(spark, rows, k, 0.3, 2.0)
        for r in out:
            assert r[f"{name}_ts"] == pytest.approx(expected[r.row_id, r[name]])


def test_a_label_does_not_reach_its_own_row(spark):
    """Turning one row's label changes other rows of its value, never its own statistic."""
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {(r.row_id, r.a, r.b): r.a_ts for r in ordered_stats(df, ["a"], "y").collect()}
    for victim in (5, 40):
        turned = df.withColumn("y", F.when(F.col("row_id") == victim, 7.0 - F.col("y")).otherwise(F.col("y")))
        found = {(r.row_id, r.a, r.b): r.a_ts for r in ordered_stats(turned, ["a"], "y").collect()}
        assert all(found[k] == plain[k] for k in plain if k[0] == victim)


def test_no_number_of_values_changes_the_encoding(spark):
    """Each value's statistics stay the same whether it is one of a few or one of thousands."""
    few = spark.range(60).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"), (F.col("id") % 2).alias("y"))
    many = few.unionByName(spark.range(1000, 4000).select(F.col("id").alias("row_id"), F.concat(F.lit("z"), "id").alias("c"), F.lit(1).alias("y")))
    own = lambda df: {r.row_id: r.c_ts for r in ordered_stats(df, ["c"], "y").where("row_id < 1000").collect()}
    assert own(few) == own(many)
    assert fit_encoder(many, ["c"], "y").tables["c"].count() == 3003


def test_encoder_scores_new_rows_and_reloads(spark, tmp_path):
    rows = made(4)
    encoder = fit_encoder(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "y", prior=0.2, strength=3.0)
    new = spark.createDataFrame([(1, "x", 2), (2, None, None), (3, "never", 77)], "row_id long, a string, b int")
    out = {r.row_id: r for r in encoder.apply(new).collect()}
    mean = lambda k, v: (sum(r[3] for r in rows if r[k] == v and r[3] is not None) + 0.6) / (sum(r[k] == v and r[3] is not None for r in rows) + 3)
    assert out[1].a_ts == pytest.approx(mean(1, "x")) and out[1].b_ts == pytest.approx(mean(2, 2))
    assert out[2].a_ts == pytest.approx(mean(1, None)) and out[3].a_ts == out[3].b_ts == 0.2
    encoder.save(str(tmp_path / "e"))
    again = load_encoder(spark, str(tmp_path / "e")).apply(new).collect()
    assert {r.row_id: r for r in again} == out


def test_odd_rows(spark):
    df = spark.createDataFrame(made(5), SCHEMA)
    assert ordered_stats(df.limit(0), ["a"], "y").count() == 0 and ordered_stats(df, [], "y").columns == df.columns
    assert fit_encoder(df.limit(0), ["a"], "y").apply(df).where("a_ts <> 0.5").count() == 0
    nameless = df.withColumn("row_id", F.when(F.col("row_id") % 2 == 0, F.col("row_id")))
    out = ordered_stats(nameless, ["a"], "y")
    assert out.count() == df.count() and out.where("row_id IS NULL AND a_ts <> 0.5").count() == 0
