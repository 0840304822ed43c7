"""Run registered queries next to their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def load(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "item"):
        return _plain(value.item())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    return value


def rows_of(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, {took:.1f} s, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}; extra {extra}; missing {missing}"
    return True, f"{len(got)} rows, {took:.1f} s"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from usetrail.queries import CHECKS, QUERIES
    from usetrail.session import build

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else list(QUERIES)
    session = build("local[8]")
    for setting in sys.argv[3:]:
        session.conf.set(*setting.split("="))
    con = load(sf)
    failed = []
    for name in wanted:
        try:
            ok, note = compare(session, con, name, QUERIES[name], CHECKS.get(name), sf)
        except Exception as error:  # a failing query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(("ok  " if ok else "FAIL"), name, note, flush=True)
        failed += [] if ok else [name]
    print(f"{len(wanted) - len(failed)} of {len(wanted)} equal; failed: {failed}")
