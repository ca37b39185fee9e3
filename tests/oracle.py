"""Run registered queries next to their oracle SQL and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


EXACT = bool(os.environ.get("ORACLE_EXACT"))  # to the last bit, and 1 is not 1.0


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value) if EXACT else f"{value:.6g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda c: columns[c])
    return sorted(tuple(plain(r[c]) for c in order) for r in records)


def compare(spark, con, folder, fn, sql):
    """'' if equal, else what differs."""
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows, want {len(want)}; extra {extra}; lost {lost}"
    for g, w in zip(got, want):
        if g != w:
            return f"got {g} want {w}"
    return "" if got else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidemark.session import local_session
    folder = sys.argv[1]
    spark, con = local_session(8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, fn, oracles.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only)'} {problem[:1800]}", flush=True)
    print("bad:", bad)
