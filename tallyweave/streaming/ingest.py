"""Continuous import: a stream of ledger rows through the idempotent append, and a watermarked spend window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import LEDGER_SCHEMA
from ..sources.store import Store


def ledger_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of ledger rows below a folder."""
    return spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each batch by key, however old its rows are: statements of past months that arrive late are the normal case
    of a ledger, so nothing is dropped for its time and rows without one are kept. No state is held: repetitions, within a
    batch or of earlier ones, are dropped by the append itself, and so is a batch that runs again after a failure."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: store.append("transactions", batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_spend(stream: DataFrame, width: str = "1 day", delay: str = "3 days") -> DataFrame:
    """Spending per window and account; a window is final once the watermark passes it, and rows later than that do not count."""
    rows = stream.where("amount < 0").withColumn("at", F.to_timestamp("datetime")).withWatermark("at", delay)
    out = rows.groupBy(F.window("at", width), "account").agg(F.count("*").alias("transaction_count"), F.abs(F.sum(F.col("amount").cast("decimal(18,2)"))).alias("total_spend"))
    return out.select("window.start", "window.end", "account", "transaction_count", "total_spend")
