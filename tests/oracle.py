"""Compare registered queries with their SQL counterparts: python -m tests.oracle [sf] [name...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    cur = con.execute(sql)
    got = [d[0] for d in cur.description]
    if sorted(got) != names:
        return f"columns {names} against {sorted(got)}"
    order = [got.index(c) for c in names]
    want = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    if len(rows) != len(want):
        return f"{len(rows)} rows against {len(want)}"
    key = lambda r: tuple((v is not None, "" if v is None else str(type(v) is str), v if v is not None else 0) for v in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    for a, b in zip(rows[:200], want[:200]):
        for x, y in zip(a, b):
            if x is not None and y is not None and type(x) is not type(y):
                return f"type {type(x)} {x!r} against {type(y)} {y!r}"
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    failed = 0
    total = time.time()
    for name in [q for q in queries if any(q == w or q.startswith(w + "_") for w in wanted)]:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                out = compare(df, con, oracles[name]) or "ok"
            else:
                out = f"rows {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            out = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += out not in ("ok",) and not out.startswith("rows ")
        print(f"{name:32s} {time.time() - start:6.2f}s  {out}", flush=True)
    print(f"{failed} failed, {time.time() - total:.0f}s", flush=True)
