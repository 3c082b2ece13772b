"""Recurring scans as a stream: new candidate files flow into versioned snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.resolve import upsert_leads
from ..operators.scoring import key_leads
from ..sources.sinks import bucket_of, buckets_of, read_snapshot, write_snapshot


def touched_buckets(batch: DataFrame, root: str) -> list[int]:
    """Buckets of the batch's keys: at most as many as the table has."""
    buckets = buckets_of(batch.sparkSession, root)
    return [r["b"] for r in key_leads(batch).select(bucket_of(buckets).alias("b")).distinct().collect()]


def upsert_batch(spark: SparkSession, root: str, now: Column, order: Sequence[str],
                 written: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch n turns version n into version n + 1, reading and writing only the buckets of its keys.

    The version comes from the batch id, so a batch that is run again after a failure reads the
    same snapshot and replaces the same output: a replay changes nothing.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        touched = touched_buckets(batch, root)
        store = read_snapshot(spark, root, batch_id, touched)
        write_snapshot(upsert_leads(store, batch, now, order), root, batch_id + 1, touched)
        if written is not None:
            written.append(batch_id + 1)

    return apply


def stream_upsert(spark: SparkSession, source: str, schema: StructType, root: str,
                  checkpoint: str, now: Column, order: Sequence[str] = ("ord",)) -> int:
    """Take in every new file below ``source``, then stop. Returns the newest version.

    Version 0 (the store before the first tick) must exist. Call it once per tick.
    """
    written: list[int] = []
    files = spark.readStream.schema(schema).parquet(source)
    query = (files.writeStream.foreachBatch(upsert_batch(spark, root, now, order, written))
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if written:
        return written[-1]
    # nothing new: the batch that would come next starts from the newest version
    return query.lastProgress["batchId"] if query.lastProgress else 0
