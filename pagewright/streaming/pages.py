"""Pages that arrive as a stream.

All row-local operators run unchanged on streaming tables. What needs a whole page works batch by batch, as a page
arrives as one row with all its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def page_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Responses as they are written into a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process_pages(pages: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs a plan on every batch of pages and appends its rows to target; each batch is written exactly once.

    A batch writes its own folder and overwrites it when it is repeated.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
