"""Small document tables for the operators' tests."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Extra columns whose names operators use inside.
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("chunk", LongType()), StructField("id", StringType()), StructField("n", StringType())])


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 7, "x", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, words=400):
    r = random.Random(seed)
    known = [f"w{k}" for k in range(words)]
    return " ".join(r.choice(known) for _ in range(n))


def awkward(seed=0):
    """Nulls, empty, short, long, repeated and overlapping texts, and rows that are there twice."""
    r = random.Random(seed)
    long = prose(seed, 1500)
    part = prose(seed + 1, 60)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, long), (6, long), (7, prose(seed + 2, 30) + " " + part + " " + prose(seed + 3, 30)), (8, part + " " + prose(seed + 4, 50)), (9, prose(seed + 5, 5) + " " + part), (10, "ab " * 300), (11, "x" * 900), (12, "ü" * 450 + prose(seed, 80)), (None, part), (None, None), (5, long), (13, prose(seed + 6, 300))]
    words = prose(seed + 7, 200).split()
    for k in range(14, 30):
        mine = list(words)
        for _ in range(k - 13):
            mine[r.randrange(len(mine))] = f"edit{k}"
        rows.append((k, " ".join(mine)))
    return rows
