"""The same lint on a stream of documents: all its work is in the row, so it needs no state and no watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.lint import lint
from quillon.plans.catalogue import Active


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def lint_stream(docs: DataFrame, out: str, checkpoint: str, rules: Sequence[Active] | None = None, key: str = "doc_id") -> StreamingQuery:
    """Writes the findings of all documents there are now, exactly once, and stops."""
    return lint(docs, rules, key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
