"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

import os

FOLDER = "/root/testdata/sf0.001"


def frame(spark, texts, schema="doc_id long, text string", partitions=3):
    rows = texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts))
    return spark.createDataFrame(rows, schema).repartition(partitions)


def awkward(spark, extra: str = "n_words"):
    """Null ids and texts, empty and very long texts, repeated rows, repeated ids, and a column with a clashing name."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(1, "The cat sat on the mat.\nAnd stayed there.", 1), (1, "another text with this id", 2), (2, None, 3), (None, "no id here at all", None)]
    rows += [(3, "", 4), (4, "  \n\t ", 5), (5, long, 6), (6, "same row", 7), (6, "same row", 7), (7, "ÄÖÜ ▁ mark é\u0000x", 8), (None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra} long").repartition(4)


def table(con, name):
    path = f"{FOLDER}/{name}.parquet"
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")


def pandas_pair(spark, name, key):
    """Result and SQL result of a query, sorted alike."""
    import duckdb

    from pollweave.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for one in ("documents", "pages", "benchmark", "labels", "conversations"):
        table(con, one)
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, FOLDER).toPandas()
    return [x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (got, want)]
