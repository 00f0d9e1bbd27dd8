"""Compare registered queries with their SQL twins: python -m codexferry.bindings.check"""

from __future__ import annotations

import sys
import time

import duckdb

from codexferry.bindings import load
from codexferry.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def main(sf_dir: str, names: list[str]) -> int:
    queries, sqls = load()
    spark = local_session("check", cpus=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        try:
            t0 = time.time()
            df = fn(spark, sf_dir)
            columns = sorted(df.columns)
            got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
            took = time.time() - t0
            if name not in sqls:
                print(f"{name:28} {took:6.1f}s rows={len(got)} no SQL", flush=True)
                continue
            t0 = time.time()
            rel = con.sql(sqls[name])
            sql_columns = sorted(rel.columns)
            types = dict(zip(rel.columns, map(str, rel.types)))
            want = sorted(
                rel.project(", ".join(f'"{c}"' for c in sql_columns)).fetchall(), key=_key
            )
            sql_took = time.time() - t0
            spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            same_types = columns == sql_columns and all(
                {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN"}.get(spark_types[c]) == types[c]
                for c in columns
            )
            ok = columns == sql_columns and got == want
            note = "" if same_types else f" TYPES {spark_types} {types}"
            print(f"{name:28} {took:6.1f}s sql {sql_took:5.1f}s rows={len(got)} "
                  f"{'ok' if ok else 'DIFFERENT'}{note}", flush=True)
            if not ok:
                bad += 1
                only = set(got) - set(want), set(want) - set(got)
                print("   spark only:", len(only[0]), str(sorted(only[0], key=_key)[:2])[:700])
                print("   sql only:  ", len(only[1]), str(sorted(only[1], key=_key)[:2])[:700])
        except Exception as problem:
            bad += 1
            print(f"{name:28} ERROR {type(problem).__name__}: {str(problem)[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
