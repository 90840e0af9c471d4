"""Compare a registered query with its SQL twin: names, types, rows and exact values.

Run as a script with query names to see differences: ``python -m tests.compare sf0.01 name ...``.
"""

from __future__ import annotations

import collections
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"integer": "int", "bigint": "bigint", "double": "double", "varchar": "string", "boolean": "boolean", "timestamp": "timestamp_ntz", "date": "date"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    return value


def sql_answer(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = [str(d[1]).lower() for d in cur.description]
    return names, kinds, cur.fetchall()


def compare(spark, con, build, sql: str, sf_dir: str) -> list[str]:
    """Empty when both answers agree."""
    df = build(spark, sf_dir)
    names, kinds, rows = sql_answer(con, sql)
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    mine = dict(df.dtypes)
    for n, k in zip(names, kinds):
        if KINDS.get(k, k) != mine[n]:
            problems.append(f"type of {n}: {mine[n]} != {k}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    left = collections.Counter(tuple(_cell(r[n]) for n in order) for r in df.collect())
    right = collections.Counter(tuple(_cell(r[i]) for i in at) for r in rows)
    if sum(left.values()) != sum(right.values()):
        problems.append(f"rows {sum(left.values())} != {sum(right.values())}")
    if not right:
        problems.append("no rows")
    only_left, only_right = left - right, right - left
    if only_left or only_right:
        by = lambda r: tuple(str(c) for c in r)
        problems.append(f"{sum(only_left.values())} / {sum(only_right.values())} rows differ, columns {order}")
        problems += [f"  spark {r}" for r in sorted(only_left, key=by)[:3]] + [f"  sql   {r}" for r in sorted(only_right, key=by)[:3]]
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as contract
    from tests.session import session

    sf_dir = f"/root/testdata/{argv[0]}"
    spark, con = session(), connect(sf_dir)
    names = argv[1:] or list(contract.queries())
    sqls, bad = contract.oracle_sql(), []
    for name in names:
        started = time.time()
        try:
            if name in sqls:
                problems = compare(spark, con, contract.queries()[name], sqls[name], sf_dir)
            else:
                rows = contract.queries()[name](spark, sf_dir).count()
                problems = [] if rows else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1200]}"]
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - started:.1f}s", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
        bad += [name] if problems else []
    print(f"{len(names) - len(bad)} of {len(names)} agree; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
