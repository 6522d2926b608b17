"""What the operators share: tables written to the shared folder, and samples of labels."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import spread

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Unset, a temporary folder serves a single-machine session; a cluster must
    name a folder that all of its executors see.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None:
            return
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have ended first
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    prefix = "__"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def labelled(docs: DataFrame, labels: DataFrame, target: str, bound: int, feature: Callable[[str], Column]) -> DataFrame:
    """(x, y, held) of at most about ``bound`` labelled documents, chosen by a hash of doc_id; x is ``feature`` of the text.

    Of several labels of one id the largest counts, of several rows of one id the
    least x, so repeated rows don't lift the bound.  Only the bounded ids are
    broadcast, so the join filters the scan of ``docs`` without a shuffle of its
    texts.  ``held`` marks a fifth kept out of the fit.
    """
    ids = labels.select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("__y")).where("__id is not null and __y is not null")
    total = ids.count()
    roll = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(1 << 30))
    if total > bound:
        ids = ids.where(roll < int(bound / total * (1 << 30)))
    ids = ids.groupBy("__id").agg(F.max("__y").alias("__y"))
    joined = docs.select(F.col("doc_id").alias("__d"), "text").join(F.broadcast(ids), F.col("__d") == F.col("__id"))
    each = joined.select("__id", "__y", feature("text").alias("__x")).groupBy("__id", "__y").agg(F.min("__x").alias("x"))
    return each.select("x", F.col("__y").alias("y"), (F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(5)) == 0).alias("held"))
