"""Scattering of streams: events have no state, so a stream's batches are mapped
like tables and written once each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import signals
from ..plans.scattering import ScatterConfig
from ..sources.scratch import remove, scratch_dir


def scatter_stream(spark: SparkSession, path: str, schema: StructType, cfg: ScatterConfig, *, id_col: str, signal_col: str, out: str | None = None, name: str = "scattered", files_per_batch: int = 16) -> DataFrame:
    """Reads every Parquet file under `path` as a stream, scatters and appends to a
    table in the shared folder; the checkpoint there makes each batch count once. Where
    no `out` is named, the state goes when the stream has ended, the table with
    `scratch.clean`. Files in folders whose names begin with `_` or `.` are not read."""
    base = out or f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # A single file is read as the one of its folder that has its name.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    alone = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    folder, names = (path.rstrip("/").rpartition("/")[0], at.getName()) if alone else (path, "*.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)
    scattered = signals.scatter(stream, cfg, id_col=id_col, signal_col=signal_col)
    q = scattered.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if out is None:
        remove(spark, f"{base}/state")
    return spark.read.schema(scattered.schema).parquet(f"{base}/rows")
