"""Run catalog queries and their oracles side by side: ``python -m tests.compare [-s SF] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

sys.path.insert(0, ".")
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def key(row):
    return tuple((v is None, str(type(v)) if v is not None else "", v if v is not None else 0) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([tuple(cell(r[n]) for n in names) for r in df.collect()], key=key)


def duck_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    names = [rel.columns[i] for i in order]
    types = {rel.columns[i]: str(rel.types[i]) for i in order}
    return names, sorted([tuple(cell(r[i]) for i in order) for r in rel.fetchall()], key=key), types


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def difference(df, con, sql):
    """None when both sides agree, else a description of the first difference."""
    names, rows = spark_rows(df)
    duck_names, expected, types = duck_rows(con, sql)
    if names != duck_names:
        return f"columns {names} != {duck_names}"
    spark_types = dict(df.dtypes)
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name in names:
        want = loose.get(spark_types[name])
        if want is not None and types[name] != want:
            return f"type of {name}: {spark_types[name]} != {types[name]}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    for mine, theirs in zip(rows, expected):
        if mine != theirs:
            bad = [(n, a, b) for n, a, b in zip(names, mine, theirs) if a != b]
            return f"{bad[:4]} in {dict(zip(names, mine))}"
    return None


def main(argv):
    from tideline.session import build_session

    folder, names = "/root/testdata/sf0.01", []
    while argv:
        arg = argv.pop(0)
        if arg == "-s":
            folder = f"/root/testdata/sf{argv.pop(0)}"
        else:
            names.append(arg)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not names or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    failed = []
    for name in names:
        begun = time.time()
        con = connect(folder)
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                found = difference(df, con, oracles[name])
                rows = ""
            else:
                found, rows = None, f" rows-only {df.count()}"
        except Exception as error:  # noqa: BLE001
            found, rows = f"{type(error).__name__}: {str(error)[:1500]}", ""
            if "-v" in sys.argv:
                traceback.print_exc()
        con.close()
        print(f"{'OK ' if found is None else 'BAD'} {name} {time.time() - begun:.1f}s{rows} {found or ''}", flush=True)
        if found:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} agree; failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
