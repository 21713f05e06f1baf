"""Run queries and their SQL side by side: python tests/oracle.py sf0.01 [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) if type(v).__name__ in ("datetime", "Timestamp", "date") else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """What differs, or nothing."""
    got = query(spark, sf_dir)
    want = (con or duck(sf_dir)).execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    mine, theirs = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows, such as {bad[0]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from docfathom.plans.registry import WRITERS
    from docfathom.session import session

    spark, sf = session("oracle", cores=int(os.environ.get("CORES", "4"))), f"/root/testdata/{sys.argv[1]}"
    con = duck(sf)
    for name, sql in (entry.oracle_sql() | WRITERS).items():
        if len(sys.argv) < 3 or name in sys.argv[2:] or any(a.endswith("*") and name.startswith(a[:-1]) for a in sys.argv[2:]):
            at = time.time()
            try:
                said = compare(spark, sf, entry.queries()[name], sql, con)
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__}: {str(e)[:600]}"
            print(f"{name}: {said or 'ok'} ({time.time() - at:.1f} s)", flush=True)
