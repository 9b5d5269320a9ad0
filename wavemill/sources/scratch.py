"""Tables written on the way: lineage ends at them, and a lost executor costs one read
instead of all that came before."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A folder for this application in the shared one that the cluster names in
    `spark.checkpoint.dir`. Only where all runs in one process (`local[...]`) may the
    setting be missing: there a temporary folder serves, which goes at exit."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            own = tempfile.mkdtemp(prefix="wavemill-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN.append("file://" + own)
        where = _OWN[0]
    return f"{where}/wavemill-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again. `clean` removes it."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Remove what this application has cut. Results that are read from it must have
    been written by then."""
    remove(spark, scratch_dir(spark))
