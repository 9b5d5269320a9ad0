"""Registered queries and their SQL, and small pieces that both need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql() if callable(sql) else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(int(v))
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


def rounded(c, n: int):
    """Rounded, with one zero."""
    return (F.round(c, n) + F.lit(0.0)).cast("double")


#: Samples of the embeddings, a row each.
X = "x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(64)) AS INTEGER) AS pos FROM embeddings)"
#: Events as weighted observations of (x, y).
EV = "e AS (SELECT event_id, user_id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, 1.0 + event_id % 3 AS w FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (1.0 + F.col("event_id") % 3).alias("w"))
