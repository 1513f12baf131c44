"""Run registered queries against their checks: ``python tests/compare.py d1_ e6_``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans import catalog  # noqa: E402
from tidemark.plans.tables import NAMES  # noqa: E402


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def family(v) -> str:
    return "none" if v is None else type(v).__name__


def normalised(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in at) for r in rows], key=repr)


def differences(spark, con, name: str, folder: str) -> list[str]:
    df = catalog.QUERIES[name](spark, folder)
    mine = normalised(df.collect(), df.columns)
    if name not in catalog.ORACLES:
        return [] if mine else ["no rows"]
    cur = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    theirs = normalised(cur.fetchall(), columns)
    out = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(columns)}"]
    if not mine:
        out.append("no rows")
    if len(mine) != len(theirs):
        out.append(f"{len(mine)} rows vs {len(theirs)}")
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        out.append(f"only here {sorted(a - b)[:3]}"[:900])
        out.append(f"only there {sorted(b - a)[:3]}"[:900])
    if mine and theirs:
        for i, c in enumerate(sorted(columns)):
            x = {family(r[i]) for r in mine} - {"none"}
            y = {family(r[i]) for r in theirs} - {"none"}
            if x != y:
                out.append(f"type of {c}: {x} vs {y}")
    return out


def main(prefixes: list[str], folder: str) -> int:
    from tidemark.session import local_session

    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    con = oracle_connection(folder)
    bad = 0
    for name in catalog.QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problems = differences(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001 - reported per query
            problems = [f"{type(e).__name__}: {str(e)[:700]}".replace("\n", " ")]
        bad += bool(problems)
        mark = "ok  " if not problems else "FAIL"
        kind = "" if name in catalog.ORACLES else " (rows only)"
        print(f"\n## {mark} {name}{kind} {time.time() - start:.1f}s", *problems, sep="\n##   ", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01")) > 0)
