"""Run registered queries beside their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def same(left: list[tuple], right: list[tuple]) -> bool:
    """Equal row by row in values and types, doubles to the last bit."""
    return left == right and all(
        type(x) is type(y) for a, b in zip(left, right) for x, y in zip(a, b)
    )


def compare(spark, db, sf_dir: str, name: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = db.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if same(got, want):
        return True, f"{len(got)} rows"
    differing = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return False, f"{len(got)} / {len(want)} rows, first differences {differing}"


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import session

    arguments = sys.argv[1:]
    sf = arguments.pop(0) if arguments else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session()
    db = connect(sf_dir)
    bad = 0
    for name in arguments or entry.queries():
        began = time.time()
        try:
            ok, detail = compare(spark, db, sf_dir, name)
        except Exception as error:  # show the query that broke and go on
            ok, detail = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:26} {time.time() - began:6.2f}s  {detail}", flush=True)
    print(f"{bad} differ")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
