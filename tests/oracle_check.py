"""Runs catalog queries next to their SQL and reports differences.

    python tests/oracle_check.py 0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def sql_engine(sf_dir: str):
    import duckdb

    engine = duckdb.connect()
    # Spilling goes to a folder of its own, and not without end.
    engine.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='run-', dir='/tmp')}'")
    engine.execute("SET max_temp_directory_size = '2GB'")
    for name in TABLES.split():
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return engine


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    if isinstance(value, bool):
        return int(value)
    return value


def canonical(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=lambda row: [(v is not None, str(v)) for v in row])


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), canonical(frame.columns, [tuple(row) for row in frame.collect()])


def sql_rows(engine, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = engine.execute(sql)
    names = [column[0] for column in cursor.description]
    return sorted(names), canonical(names, cursor.fetchall())


def difference(mine, theirs) -> str | None:
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    for one, other in zip(mine[1], theirs[1]):
        if one != other:
            return f"{mine[0]}\n   {one}\n   {other}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from shelltrail.session import local_session

    sf_dir = f"{DATA}/sf{sys.argv[1]}"
    spark, engine = local_session(8), sql_engine(sf_dir)
    sqls, failures = oracle_sql(), 0
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            mine = spark_rows(query(spark, sf_dir))
            taken = time.time() - started
            problem = difference(mine, sql_rows(engine, sqls[name])) if name in sqls else "no sql"
        except Exception as error:  # noqa: BLE001
            taken, mine, problem = time.time() - started, (None, []), f"{type(error).__name__}: {str(error)[:800]}"
        failures += problem not in (None, "no sql")
        print(f"{name:36s} {len(mine[1]):7d} rows {taken:6.2f}s  {'ok' if problem is None else problem}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
