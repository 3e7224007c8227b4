"""Incremental ingestion (an extension): new files become chunks and replace older ones of the same id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import chunking


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """stream: document rows. Each batch appends its chunks under its own number; readers keep the latest of an id."""

    def add(batch: DataFrame, number: int) -> None:
        cleaned = batch.withColumn("text", chunking.clean(F.col("text"))).where("text <> ''")
        chunking.chunk(cleaned).withColumn("ingested_at", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
