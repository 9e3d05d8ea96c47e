"""The online layer over a stream of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.operators import address as A


def redacted_stream(addresses: DataFrame, column: str = "text") -> DataFrame:
    """Redaction, tagging, decoding and normalization; stateless, so it is the same for a stream and a table."""
    return A.normalize(A.decode(A.tag(A.redact(addresses, column))))


def gated(addresses: DataFrame, prepared: A.Lookup, key: str = "address_id", column: str = "text") -> DataFrame:
    """Each address through the gate against the prepared hierarchy; for a stream a stateless stream-static join, for a table a join."""
    return A.gate(A.validate(redacted_stream(addresses, column), prepared, key))


def gate_batches(addresses: DataFrame, prepared: A.Lookup, path: str, checkpoint: str, key: str = "address_id"):
    """A writer that appends the gated addresses of a stream to Parquet at path, each exactly once: the sink's own log says which files count."""
    out = gated(addresses, prepared, key).select(key, "address_text", "status", "reason_code", "gate_status", "issues")
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def status_counts(gated: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of gate statuses by event-time window, with a watermark for late rows."""
    return gated.withWatermark(time, late).groupBy(F.window(time, window), "gate_status").count()
