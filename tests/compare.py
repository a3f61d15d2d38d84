"""Run registered queries in Spark and their SQL in DuckDB and compare schema and values.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {
    "bigint": "bigint", "int": "int", "integer": "int", "string": "string", "varchar": "string",
    "double": "double", "boolean": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides have the same columns, types and multiset of rows."""
    names = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})")
    theirs_types = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1])) for d in cur.description}
    theirs = [tuple(r) for r in cur.fetchall()]
    width = len(con.execute(f"DESCRIBE {sql}").fetchall())
    ours_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    ours = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    found = []
    if width != len(names):
        found.append(f"{len(names)} columns against {width}")
    if ours_types != theirs_types:
        found.append(f"types {ours_types} against {theirs_types}")
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows against {len(theirs)}")
    a, b = sorted(ours, key=_key), sorted(theirs, key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        found.append(f"{len(bad)} rows differ, first: {str(bad[0])[:400]}")
    if not ours:
        found.append("no rows")
    return found


if __name__ == "__main__":
    from session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, oracle = local_session(), connect(sf), entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracle:
                found = differences(query(spark, sf), con, oracle[name])
            else:
                found = [] if query(spark, sf).collect() else ["no rows"]
            print(f"{'DIFF' if found else 'ok  '} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
        except Exception as error:  # one broken query must not hide the others
            print(f"FAIL {name} {str(error)[:600]}", flush=True)
