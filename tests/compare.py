"""Run queries and their SQL side by side: python tests/compare.py [--sf 0.01] [NAME or PREFIX* ...]."""

from __future__ import annotations

import fnmatch
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings new_link inference_summary updates_links roa as_cone netfac netixlan mix_target".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return repr(v)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    began = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f} s"
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"{len(got)} rows against {len(want)}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    kinds = {c[0]: str(c[1]) for c in rel.description}
    return True, f"{len(got)} rows, {took:.1f} s, spark {[(c, t) for c, t in df.dtypes]} sql {kinds}" if "-v" in sys.argv else f"{len(got)} rows, {took:.1f} s"


def main(args: list[str]) -> int:
    from hopwarden.session import local_session

    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in args:
        sf = args.pop(args.index("--sf") + 1)
        args.remove("--sf")
    sf_dir = f"/root/testdata/sf{sf}"
    names = [a for a in args if a != "-v"] or ["*"]
    spark = local_session()
    queries, sql = entry.queries(), entry.oracle_sql()
    con, bad = connect(sf_dir), 0
    for name in queries:
        if any(fnmatch.fnmatch(name, n) for n in names):
            try:
                ok, said = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
            except Exception as e:  # noqa: BLE001
                ok, said = False, f"{type(e).__name__}: {str(e)[:700]}"
            bad += not ok
            print("ok  " if ok else "FAIL", name, said, flush=True)
    return bad


if __name__ == "__main__":
    code = main(sys.argv[1:])
    sys.stdout.flush()
    import os

    os._exit(bool(code))
