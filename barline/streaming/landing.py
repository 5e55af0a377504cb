"""Refresh from a landing folder as files arrive: the batch refresh, driven by Structured Streaming.

The market data itself is daily and keyed, so there is no event-time state: each micro-batch is a plain
upsert, which makes a replayed batch harmless. The query's checkpoint folder remembers which files are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.refresh import load_bars
from ..sources import landed
from ..sources.warehouse import Warehouse


def watch_bars(
    spark: SparkSession, folder: str, wh: Warehouse, splits: DataFrame, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Upsert every bar page that lands in ``folder``; stops when all files present are done."""
    pages = (
        spark.readStream.schema(landed.BAR_PAGES)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )

    def upsert(batch: DataFrame, epoch: int) -> None:
        named = landed.bars(batch).withColumn("epoch", F.lit(epoch))
        load_bars(wh, named, splits, ["epoch", "close"], f"landing batch {epoch}")

    writer = pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
