"""Scans of files as they arrive; every per-file operator is narrow and runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codestrata.operators import corpus, patterns


def scan_stream(arriving: DataFrame, folder: str, checkpoint: str):
    """Start a query that appends pattern findings of arriving files to Parquet in ``folder``; progress is in ``checkpoint``."""
    found = patterns.line_findings(corpus.with_lines(corpus.scanned(arriving)))
    return found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start()
