"""Compare each query with its SQL: rows as sorted tuples by column name, floats rounded."""

import math


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        if isinstance(v, float):
            return "0.0" if v == 0 else repr(float(v)) if not math.isnan(v) else "nan"
        return str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def differences(spark, con, name, run, sql, sf_dir):
    df = run(spark, sf_dir)
    got, a = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, b = canonical([d[0] for d in cur.description], cur.fetchall())
    if a != b:
        return f"{name}: columns {a} {b}"
    if got != want:
        odd = [(x, y) for x, y in zip(got, want) if x != y][:3]
        return f"{name}: {len(got)} rows, {len(want)} wanted; {odd}"
    return None


def connect(sf_dir):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con
