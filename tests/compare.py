"""Run registered queries and their DuckDB statements side by side: python tests/compare.py [folder] [name ...]."""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def expected(connection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    names = [entry[0] for entry in result.description]
    order = sorted(range(len(names)), key=lambda n: names[n])
    return sorted(names), Counter(tuple(row[n] for n in order) for row in result.fetchall())


def actual(rows) -> tuple[list[str], Counter]:
    names = sorted(rows.columns)
    return names, Counter(tuple(row[name] for name in names) for row in rows.collect())


def main() -> None:
    from tests.conftest import make_session
    from tillmart.oracle import ORACLE
    from tillmart.registry import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark, connection = make_session(), duck(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            rows = QUERIES[name](spark, sf_dir)
            got = actual(rows)
        except Exception as error:
            print(f"FAIL {name}: {str(error)[:600]}")
            bad += 1
            continue
        seconds = time.time() - start
        if name not in ORACLE:
            print(f"rows {name}: {sum(got[1].values())} in {seconds:.2f}s")
            continue
        try:
            want = expected(connection, ORACLE[name])
        except Exception as error:
            print(f"SQL  {name}: {str(error)[:600]}")
            bad += 1
            continue
        if got == want:
            print(f"ok   {name}: {sum(got[1].values())} rows in {seconds:.2f}s")
        else:
            bad += 1
            print(f"DIFF {name}: {got[0]} / {want[0]}; rows {sum(got[1].values())} / {sum(want[1].values())}")
            print("   only spark ", list((got[1] - want[1]).items())[:3])
            print("   only duckdb", list((want[1] - got[1]).items())[:3])
    missing = set(ORACLE) - set(QUERIES)
    print(f"{len(chosen)} queries, {bad} bad, statements without query: {sorted(missing)}")


if __name__ == "__main__":
    main()
