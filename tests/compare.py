"""Compare registered queries with their SQL, value by value."""

import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def database(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return db


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark, folder, name, query, sql):
    """None if equal, else a short account."""
    frame = query(spark, folder)
    columns, got = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    relation = database(folder).sql(sql)
    want_columns, want = sorted_rows(relation.columns, relation.fetchall())
    if columns != want_columns:
        return f"{name}: columns {columns} / {want_columns}"
    if got != want:
        only = [str(r)[:300] for r in got if r not in set(want)][:3]
        missing = [str(r)[:300] for r in want if r not in set(got)][:3]
        return f"{name}: {len(got)} / {len(want)} rows, only here {only}, missing {missing}"
    return None
