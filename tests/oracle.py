"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def check(spark, folder, query, sql):
    frame = query(spark, folder)
    result = connect(folder).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, frame.collect()) == rows(names, result.fetchall())
