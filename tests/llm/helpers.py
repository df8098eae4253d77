from __future__ import annotations

from pyspark.sql import DataFrame

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, size long, ids string, shard string, band string, component string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
#: Nulls, empty, blank and very long texts, ties, repeated rows; SCHEMA adds columns with clashing names.
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, "One TWO"), (7, LONG), (None, "no id here at all"), (8, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "é è 数 字 password=abcdefghijkl12"), (10, LONG)]


def edge(spark) -> DataFrame:
    return spark.createDataFrame([(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t), "x", 5, "x", "x", "x", "x") for k, (i, t) in enumerate(TEXTS)], SCHEMA)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n: int = 0) -> DataFrame:
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(n)], "doc_id long, quality int, toxic int")
