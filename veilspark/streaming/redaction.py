"""The pipeline over streams: it is stateless, so the batch steps run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import RedactionPipeline, each


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def redact_stream(docs: DataFrame, pipeline: RedactionPipeline | None = None) -> DataFrame:
    return (pipeline or RedactionPipeline()).transform(docs)


def write_redacted(done: DataFrame, path: str, checkpoint: str, columns: tuple[str, ...] = ("doc_id", "sanitized_text", "decision", "severity_label", "severity_score"), once: bool = True) -> StreamingQuery:
    """Parquet with exactly-once files; ``once`` ends after what is there now."""
    out = done.select(*columns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def rollup(done: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Spans and masked spans by type in tumbling windows of event time."""
    spans = done.withWatermark(time, late).transform(lambda d: each(d, "spans", time, "s"))
    return spans.groupBy(F.window(time, width), F.col("s.pii_type").alias("pii_type")).agg(F.count("*").alias("spans"), F.count_if(F.col("s.decision.action") != "ALLOW").alias("masked"))
