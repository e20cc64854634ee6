"""Compare a query with its SQL on DuckDB: row count, column names, sorted values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, norm(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return norm(value.asDict())
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql):
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = rows(got_names, got), rows(want_names, want)
    if a == b:
        kinds = {type(v).__name__ for r in got[:50] for v in r} ^ {type(v).__name__ for r in want[:50] for v in r}
        note = f" types differ: {kinds}" if kinds - {"NoneType"} else ""
        return f"ok {len(a)}{note}" if a else "ok but EMPTY"
    in_a, in_b = set(a), set(b)
    only_a, only_b = [x for x in a if x not in in_b][:3], [x for x in b if x not in in_a][:3]
    return f"DIFF rows {len(a)} vs {len(b)}\n   spark only {only_a}\n   sql only {only_b}"


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from draftloom.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{sf}"
    con, sql = connection(sf_dir), oracle_sql()
    for name, build in queries().items():
        if wanted and not any(name == x or (x.endswith("*") and name.startswith(x[:-1])) for x in wanted):
            continue
        t = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sql:
                result = compare(df, con, sql[name])
            else:
                result = f"rows {len(df.collect())} (no SQL)"
        except Exception as e:  # noqa: BLE001
            result = "ERROR " + str(e)[:700]
        print(f"{name:28s} {time.time() - t:6.1f}s {result}", flush=True)
