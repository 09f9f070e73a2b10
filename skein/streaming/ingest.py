"""Streaming ingest of documents; an extension beside the batch path.

New documents are deduplicated by content hash and appended to the index folder batch by
batch; a batch that is run again after a failure writes the same folder again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions.ids import content_hash


def ingest(stream: DataFrame, path: str, checkpoint: str, process=None, delay: str | None = None, time_col: str = "ts") -> StreamingQuery:
    """Start appending the stream's new documents under `path`, through `process` if given.

    With `delay`, state older than the watermark is dropped, so it stays bounded."""
    s = stream.where("text is not null").withColumn("doc_hash", content_hash(F.col("text")))
    s = s.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["doc_hash"]) if delay else s.dropDuplicates(["doc_hash"])

    def write(batch: DataFrame, batch_id: int) -> None:
        (process(batch) if process else batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, window: str, delay: str, by: str = "event_type") -> DataFrame:
    """Events by time window; late ones within the delay still count."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
