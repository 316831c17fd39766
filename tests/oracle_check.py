"""Run registered queries and their SQL side by side and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


FAMILY = {"bigint": "long", "int": "int", "integer": "int", "double": "double", "string": "text",
          "varchar": "text", "boolean": "boolean", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts",
          "smallint": "short", "tinyint": "byte", "float": "float"}


def compare(name, spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    kinds = {f.name: FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return f"rows-only {len(got)}", True
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}", False
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in rows]
    types = {d[0]: FAMILY.get(str(d[1]).lower(), str(d[1]).lower()) for d in con.execute(
        f"DESCRIBE {sql}").fetchall()}
    notes = [f"{c}:{kinds[c]}/{types[c]}" for c in cols if kinds[c] != types[c] and "<" not in kinds[c]
             and "[" not in types[c]]
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} sql {len(want)} {notes}", False
    key = lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in r)
    a, b = sorted(got, key=lambda r: str(r)), sorted(want, key=lambda r: str(r))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {cols}: {bad[0]} {notes}", False
    return f"ok {len(a)} rows" + (f" TYPES {notes}" if notes else ""), not notes


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from gridpulse.session import build_session
    sf_dir = "/root/testdata/sf" + sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            note, ok = compare(name, spark, con, sf_dir, fn, sql.get(name))
        except Exception as error:  # noqa: BLE001
            note, ok = f"{type(error).__name__}: {str(error)[:700]}", False
        print(f"{'PASS' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
