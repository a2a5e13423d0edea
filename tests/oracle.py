"""Run a query's SQL in DuckDB and compare it with the Spark result."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(float(f"{v:.9g}") + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    if hasattr(v, "quantize"):
        return _cell(float(v))
    return repr(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([_cell(r[i]) for i in order]) for r in rows)


def run_sql(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    return table_of([d[0] for d in cur.description], cur.fetchall())


def run_spark(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])
