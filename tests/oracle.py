"""Run registered queries next to their SQL in DuckDB and compare the rows.

``python tests/oracle.py [name part ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value as both engines would print it."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = sorted(tuple(plain(row[i]) for i in order) for row in rows)
    return [names[i] for i in order], table


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> tuple[bool, str]:
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if name not in oracles:
        return len(got) > 0, f"rows-only {len(got)} rows {took:.1f}s"
    res = con.execute(oracles[name])
    want_names, want = rows_of([d[0] for d in res.description], res.fetchall())
    names, table = rows_of(df.columns, [tuple(x) for x in got])
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if table != want:
        extra = [x for x in table if x not in set(want)][:3]
        missing = [x for x in want if x not in set(table)][:3]
        return False, f"rows {len(table)} vs {len(want)}\n   {names}\n   spark {extra}\n   sql   {missing}"
    return len(got) > 0, f"{len(got)} rows {took:.1f}s"


def main() -> None:
    import __spark_entry__ as entry
    from panelcast.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    args = [a for a in sys.argv[1:] if not a.startswith("--sf=")]
    for a in sys.argv[1:]:
        if a.startswith("--sf="):
            sf_dir = f"/root/testdata/sf{a[5:]}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = [q for q in queries if not args or any(q.startswith(a) for a in args)]
    spark, con = build_session("oracle"), connect(sf_dir)
    bad = 0
    for name in picked:
        try:
            ok, text = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, text, flush=True)
    print(f"{len(picked) - bad} of {len(picked)} ok")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
