"""Compare registered queries with their oracles on one data folder.

usage: python tools/parity.py [--large] [sf_dir] [name ...]

--large lowers every size limit so that all queries take the paths meant for
tables that do not fit a broadcast or a single window.
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from cohortal.catalog import ORACLES, QUERIES  # noqa: E402
from cohortal.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    got = QUERIES[name](spark, sf_dir)
    mine = rows_of(got.columns, [tuple(x) for x in got.collect()])
    if name not in ORACLES:
        return bool(mine), f"rows only, {len(mine)} rows"
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(got.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(columns)}"
    if mine == theirs:
        return True, f"{len(mine)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    first = bad[0] if bad else ("", "")
    return False, f"{len(mine)} vs {len(theirs)} rows, {len(bad)} differ\n  spark  {str(first[0])[:400]}\n  oracle {str(first[1])[:400]}"


def use_large_paths() -> None:
    from cohortal.core import lookup, ranks  # noqa: F401
    from cohortal.sources import views

    modules = sys.modules
    modules["cohortal.core.lookup"].BROADCAST_BYTES = 20
    modules["cohortal.core.ranks"].WINDOW_ROWS = 3
    modules["cohortal.core.ranks"].TOP_ROWS = 0
    modules["cohortal.core.ranks"].EDGE_ROWS = 3


def main() -> int:
    args = [a for a in sys.argv[1:] if a != "--large"]
    if "--large" in sys.argv:
        use_large_paths()
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark, con, failed = local_session(8), connect(sf_dir), []
    for name in names:
        start = time.time()
        try:
            good, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not good:
            failed.append(name)
        print(f"{'ok  ' if good else 'FAIL'} {name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
