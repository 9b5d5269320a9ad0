"""Tensors kept under their identifiers, and the runs of a session.

Both are Parquet tables in a folder that the cluster shares; files named by an
identifier can be read as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.provenance import is_oid, oid, tensor_bytes
from .scratch import remove

SCHEMA = "oid string, dtype string, shape array<int>, bytes binary"
NUMPY = {"float32": "<f4", "float64": "<f8", "uint8": "u1", "uint32": "<u4"}


class TensorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def put(self, x: np.ndarray, dtype: str) -> str:
        """Writing a tensor that is there changes nothing."""
        b = tensor_bytes(x, dtype)
        name = oid(b)
        if self.table().where(F.col("oid") == name).isEmpty():
            self.spark.createDataFrame([(name, dtype, list(np.shape(x)), bytearray(b))], SCHEMA).write.mode("append").parquet(self.path)
        return name

    def get(self, name: str) -> np.ndarray:
        return self.get_many([name])[name]

    def get_many(self, names: list[str]) -> dict[str, np.ndarray]:
        """By one scan; identifiers are checked against the bytes."""
        for name in names:
            if not is_oid(name):
                raise ValueError(f"{name} is no identifier")
        out: dict[str, np.ndarray] = {}
        for row in self.table().where(F.col("oid").isin(list(names))).collect() if names else []:
            b = bytes(row.bytes)
            if oid(b) != row.oid:
                raise ValueError(f"the bytes of {row.oid} have changed")
            out[row.oid] = np.frombuffer(b, NUMPY[row.dtype]).reshape(row["shape"])
        for name in names:
            if name not in out:
                raise KeyError(name)
        return out

    def put_column(self, df: DataFrame, column: str, dtype: str) -> None:
        """Every row's vector, each tensor once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                rows = [np.array(v) for v in t.column(0).to_pylist() if v is not None]
                data = [tensor_bytes(r, dtype) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([oid(b) for b in data], pa.string()), pa.array([dtype] * len(data), pa.string()), pa.array([list(r.shape) for r in rows], pa.list_(pa.int32())), pa.array(data, pa.binary())], names=["oid", "dtype", "shape", "bytes"])

        new = df.select(column).mapInArrow(run, SCHEMA).dropDuplicates(["oid"])
        new.join(self.table().select("oid"), "oid", "left_anti").select("oid", "dtype", "shape", "bytes").write.mode("append").parquet(self.path)

    def remove(self, name: str) -> bool:
        """Forget a tensor; whether it was there. The table is written anew without it,
        as Parquet files do not change."""
        if not is_oid(name):
            raise ValueError(f"{name} is no identifier")
        if self.table().where(F.col("oid") == name).isEmpty():
            return False
        rest = f"{self.path}-{name}"
        self.table().where(F.col("oid") != name).write.mode("overwrite").parquet(rest)
        self.spark.read.schema(SCHEMA).parquet(rest).write.mode("overwrite").parquet(self.path)
        remove(self.spark, rest)
        return True

    def drop(self) -> None:
        """Remove the table."""
        remove(self.spark, self.path)

    def verified(self) -> DataFrame:
        """The table with `ok`: do the bytes have their identifier."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                ok = [oid(b.as_py()) == i.as_py() for i, b in zip(t.column(0), t.column(3))]
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(ok, pa.bool_())], names=[*t.schema.names, "ok"])

        return self.table().mapInArrow(run, SCHEMA + ", ok boolean")

    def from_files(self, folder: str) -> DataFrame:
        """(oid, bytes, ok) of files named by an identifier."""
        files = self.spark.read.format("binaryFile").load(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                ok = [oid(b.as_py()) == i.as_py() for i, b in zip(t.column(0), t.column(1))]
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(ok, pa.bool_())], names=["oid", "bytes", "ok"])

        named = files.select(F.regexp_extract("path", r"([0-9a-f]{28})(\.bin)?$", 1).alias("oid"), F.col("content").alias("bytes"))
        return named.where("oid <> ''").mapInArrow(run, "oid string, bytes binary, ok boolean")
