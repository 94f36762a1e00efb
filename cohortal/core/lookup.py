"""Attach per-key statistics to rows without ever piling a key onto one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

BROADCAST_BYTES = 32 << 20  # estimated size up to which a table is sent to every task
HEAVY_SHARE = 0.001
ROWS_PER_TASK = 1_000_000  # rows of one key that a task may take before the key is shared by several
# Estimated bytes of a value by type; nested values are taken as wide.
_WIDTHS = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "string": 40, "binary": 200, "array": 800, "map": 1600}


def _matches(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]):
    return reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[r]) for l, r in pairs])


def row_bytes(table: DataFrame) -> int:
    """Estimated size of a row from its schema; a struct counts its fields."""

    def width(kind) -> int:
        if isinstance(kind, StructType):
            return 8 + sum(width(f.dataType) for f in kind.fields)
        return 8 + _WIDTHS.get(kind.typeName(), 8)

    return width(table.schema)


def _heavy_keys(rows: DataFrame, keys: Sequence[str]) -> dict[int, int]:
    """Hash and number of rows of keys that may hold more than 0.1 % of the rows: at most 1,000, from two narrow passes.

    The frequent-item sketch can name a key too many but misses none; the second
    pass counts what it names.
    """
    hashed = rows.select(F.xxhash64(*keys).alias("_h"))
    named = list(hashed.freqItems(["_h"], HEAVY_SHARE).first()[0] or [])
    if not named:
        return {}
    return {r["_h"]: r["n"] for r in hashed.where(F.col("_h").isin(named)).groupBy("_h").agg(F.count(F.lit(1)).alias("n")).collect()}


def _shares(n: int, parallel: int) -> int:
    """Tasks that share a key of ``n`` rows: one per ROWS_PER_TASK, at least a few where there are tasks to spare."""
    return max(2, min(parallel, 64), -(-n // ROWS_PER_TASK))


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str] | str,
    spread: Sequence[str] | str,
    *,
    how: str = "left",
    max_bytes: int | None = None,
    skewed: bool = True,
) -> DataFrame:
    """Join ``rows`` to ``table``, which is settled and has one row per key.

    The table is counted first (parquet footers only). If its rows times their
    estimated width stay within ``max_bytes`` (default BROADCAST_BYTES) it is
    broadcast and ``rows`` is not shuffled. Beyond that both sides shuffle on
    (key, salt). Only heavy keys get a salt, taken from ``spread``, the columns
    that identify a row: a key is shared by as many tasks as its number of rows
    asks for, and the table grows by one row for each of them.
    ``skewed=False`` skips the search where keys are known to be spread evenly.
    Null keys match null keys.
    """
    keys = [on] if isinstance(on, str) else list(on)
    ids = [spread] if isinstance(spread, str) else list(spread)
    renamed = table.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        *[c for c in table.columns if c not in keys],
    )
    key_cols = [f"_key_{k}" for k in keys]
    pairs = list(zip(keys, key_cols))
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    if table.count() * row_bytes(table) <= limit:
        joined = rows.join(F.broadcast(renamed), _matches(rows, renamed, pairs), how)
        return joined.drop(*key_cols)
    heavy = _heavy_keys(rows, keys) if skewed else {}
    if not heavy:
        return rows.join(renamed, _matches(rows, renamed, pairs), how).drop(*key_cols)
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.create_map(*[F.lit(x) for h, n in heavy.items() for x in (h, _shares(n, parallel))])
    own = F.coalesce(F.try_element_at(shares, F.xxhash64(*keys)), F.lit(1))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*ids), own.cast("bigint")).cast("int"))
    last = F.coalesce(F.try_element_at(shares, F.xxhash64(*key_cols)), F.lit(1)) - 1
    copies = renamed.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), last)))
    joined = salted.join(copies, _matches(salted, copies, pairs + [("_salt", "_salt_r")]), how)
    return joined.drop(*key_cols, "_salt", "_salt_r")
