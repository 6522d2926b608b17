"""The package on the executors: shipped once for each application."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of a table that may be moved for the sake of parallelism.
SMALL = 64 << 20


def ship(spark: SparkSession) -> None:
    """Make ``veilspark`` importable in Python workers that don't have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="veilspark-"), "veilspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that spark.checkpoint.dir names and read again; a single-machine session without one uses a temporary folder."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    path = f"{folder}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are so few and small that some cores would have no row group to read.

    A large table is read as it lies: it has more row groups than there are
    cores, and moving its texts would cost more than it gains.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores or not files:
        return df
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, files))
    return df.repartition(cores) if size < SMALL else df
