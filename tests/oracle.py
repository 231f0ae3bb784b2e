"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import os

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) if isinstance(r[i], list) else r[i] for i in order) for r in got), key=repr)


def same(spark, name, sf_dir="/root/testdata/sf0.01"):
    ours = entry.queries()[name](spark, sf_dir)
    mine = rows(ours.columns, ours.collect())
    con = connect(sf_dir)
    said = con.execute(entry.oracle_sql()[name])
    theirs = rows([d[0] for d in said.description], said.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1]):
        assert a == b
    return mine
