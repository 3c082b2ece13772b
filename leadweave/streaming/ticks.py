"""Scheduled scans as a stream: each micro-batch of requests is one tick, from the scan to the report and the history."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from ..plans import report, scan
from ..schema import SEARCH_SCHEMA
from ..session import materialize
from ..sources.searches import with_defaults
from ..sources.sinks import append_scan_history, read_snapshot, write_snapshot
from .upsert import touched_buckets

#: a saved search, and when its run was due
REQUEST_SCHEMA = StructType([*SEARCH_SCHEMA.fields, StructField("requested_at", TimestampType())])
HISTORY = "label string, started_at string, searches long, discovered long, enriched long, inserted long, updated long, unchanged long"


def history_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/history/v={version:09d}"


def report_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/reports/v={version:09d}"


def read_history(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Runs up to a version, latest first; version 0 has none."""
    return spark.read.schema(HISTORY).parquet(history_path(root, version)) if version else spark.createDataFrame([], HISTORY)


def scan_tick(root: str, inputs: Mapping[str, DataFrame], label: str = "scheduled", days: int = 1,
              written: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch n: run its searches, take what they find into the store, write report and history of version n + 1.

    All that a tick writes is named by its version and follows from the version before and the requests, the time included: it is the
    latest ``requested_at``. So a tick that runs again after a failure replaces its own output by the same.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, version, leads = batch.sparkSession, batch_id + 1, f"{root.rstrip('/')}/leads"
        due = batch.agg(F.date_format(F.max("requested_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        now = F.to_timestamp(F.lit(due), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        searches = with_defaults(batch.drop("requested_at"))
        found = materialize(scan.scan(searches, inputs), "found")
        touched = touched_buckets(found, leads)
        store = read_snapshot(spark, leads, batch_id, touched)
        run = _summary(scan.scan_totals(store, found), searches, due, label)
        write_snapshot(scan.store_scan(store, found, now), leads, version, touched)
        append_scan_history(read_history(spark, root, batch_id), run).write.mode("overwrite").parquet(history_path(root, version))
        if due is not None:
            report.write_report(report.period_report(read_snapshot(spark, leads, version), now, days), now, days, report_path(root, version))
        if written is not None:
            written.append(version)

    return apply


def _summary(totals: DataFrame, searches: DataFrame, due: str | None, label: str) -> DataFrame:
    """One row of counters for the whole tick."""
    counts = ["discovered", "enriched", "inserted", "updated", "unchanged"]
    whole = totals.filter(F.col("search_id").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts])
    asked = searches.agg(F.count(F.lit(1)).alias("searches"))
    both = asked.select("searches", F.lit(1).alias("one")).join(whole.withColumn("one", F.lit(1)), "one")
    started = F.date_format(F.to_timestamp(F.lit(due), "yyyy-MM-dd HH:mm:ss.SSSSSS"), "yyyy-MM-dd'T'HH:mm:ss")
    return both.select(F.lit(label).alias("label"), started.alias("started_at"), "searches", *counts)


def stream_scans(spark: SparkSession, source: str, inputs: Mapping[str, DataFrame], root: str, checkpoint: str,
                 label: str = "scheduled", days: int = 1) -> int:
    """Run every request that landed below ``source``, then stop. Returns the newest version.

    ``root``/leads must hold version 0, the store before the first tick. Call it once per tick.
    """
    written: list[int] = []
    requests = spark.readStream.schema(REQUEST_SCHEMA).parquet(source)
    query = (requests.writeStream.foreachBatch(scan_tick(root, inputs, label, days, written))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    if written:
        return written[-1]
    return query.lastProgress["batchId"] if query.lastProgress else 0
