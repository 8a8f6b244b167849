"""Awkward rows that every operator must take, and brute-force counterparts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, norm string, place int, target double"
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 9000


def rows() -> list[tuple]:
    texts = [
        (1, "One two three four five six seven eight nine ten eleven twelve."), (2, "one TWO three four five six seven eight nine ten eleven twelve."), (3, None), (4, ""), (5, "   \n\t "),
        (6, LONG), (7, LONG), (8, "same line that is long enough here\nshort\nother line number eight is here"), (9, "same line that is long enough here\nshort"), (10, "same line that is long enough here "),
        (10, "same line that is long enough here "), (None, "same line that is long enough here"), (None, None), (11, "Ärger é \U0001f600 Аbc it's we'll 123 ٣"), (12, "w " * 70), (13, "w " * 90),
    ]
    out = []
    for i, (k, t) in enumerate(texts):
        out.append((k, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", "y", "z", 1, 0.5))
    return out


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, n: int = 0) -> DataFrame:
    return spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(n)] + [(None, None, None)], "doc_id long, quality int, toxic int")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sample(sf: str = "sf0.001") -> list[tuple]:
    import pyarrow.parquet as pq

    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "y", "z", 1, 0.5) for r in t]
