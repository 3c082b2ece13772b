"""CSV export, report files, scan history and lead snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..fixed_values import HISTORY_SIZE
from ..operators.query import export_projection, lookup_lead
from ..schema import EXPORT_COLUMNS, LEAD_SCHEMA, blank_missing

_CSV = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_leads_csv(df: DataFrame, path: str) -> None:
    """The 21 export columns as RFC 4180 CSV parts, UTF-8 without a byte-order mark."""
    export_projection(df).write.mode("overwrite").options(**_CSV).csv(path)


def read_leads_csv(spark: SparkSession, path: str) -> DataFrame:
    types = ", ".join(f"{c} {'int' if c == 'confidence_score' else 'string'}" for c in EXPORT_COLUMNS)
    return blank_missing(spark.read.schema(types).options(**_CSV, multiLine="true").csv(path))


def append_scan_history(history: DataFrame | None, runs: DataFrame,
                        size: int = HISTORY_SIZE) -> DataFrame:
    """History with the new runs, cut to the latest ``size`` (a top-k, not a global sort)."""
    both = runs if history is None else history.unionByName(runs)
    # runs of one second stand in an order of their own, so the cut is the same each time
    return both.orderBy(F.desc("started_at"), F.xxhash64(*sorted(both.columns))).limit(size)


#: parts of a new lead table by hash of the lead id; a version rewrites those that it changes
BUCKETS = 64
#: columns whose lower-case form is stored beside them, so that equality in any case is a filter that the scan knows
FOLDED = {c: f"{c}_folded" for c in ("industry", "category", "city", "governorate", "country")}


def bucket_of(buckets: int, lead_id: Column | None = None) -> Column:
    """The bucket of a lead: of its id, or of the id that its key gives."""
    return F.pmod(F.xxhash64(F.md5("dedup_key") if lead_id is None else lead_id), F.lit(buckets)).cast("int")


def _data(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/data/v={version:09d}"


def _manifest(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/manifest/v={version:09d}"


def buckets_of(spark: SparkSession, root: str) -> int:
    """The number of buckets of a stored lead table."""
    return spark.read.schema("buckets int").parquet(f"{root.rstrip('/')}/layout").first()["buckets"]


def read_manifest(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """The version in which each bucket that holds rows was last written: at most as many entries as buckets."""
    rows = spark.read.schema("bucket int, version int").parquet(_manifest(root, version)).collect()
    return {r["bucket"]: r["version"] for r in rows}


def write_snapshot(df: DataFrame, root: str, version: int, touched: list[int] | None = None, buckets: int = BUCKETS) -> None:
    """Write one version of the lead table, or of its ``touched`` buckets, which df then holds whole.

    The other buckets stay those of the version before. The manifest comes last: a reader sees a version
    complete or not at all. Writing a version again replaces it, so retries are safe. ``buckets`` counts for version 0 and stays with
    the table: choose it so that a bucket holds some hundred megabytes.
    """
    spark = df.sparkSession
    if version == 0:
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/layout")
    else:
        buckets = buckets_of(spark, root)
    folded = [F.lower(c).alias(f) for c, f in FOLDED.items()]
    # ranges of (bucket, id): a task writes few buckets, a large bucket is written by many tasks
    rows = df.select(*LEAD_SCHEMA.fieldNames(), *folded, bucket_of(buckets).alias("bucket")).repartitionByRange("bucket", "lead_id")
    (rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#dedup_key", "true").option("parquet.bloom.filter.enabled#lead_id", "true")
     .partitionBy("bucket").parquet(_data(root, version)))
    with_bucket = StructType([*LEAD_SCHEMA.fields, StructField("bucket", IntegerType())])
    written = spark.read.schema(with_bucket).parquet(_data(root, version)).select("bucket").distinct().collect()
    kept = {} if touched is None else {b: v for b, v in read_manifest(spark, root, version - 1).items() if b not in touched}
    entries = [*kept.items(), *((r["bucket"], version) for r in written)]
    spark.createDataFrame(entries, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(_manifest(root, version))


def read_snapshot(spark: SparkSession, root: str, version: int, only: list[int] | None = None, folded: bool = False) -> DataFrame:
    """One version, or some of its buckets. Upserts never write NULL text, so nothing stands between filters and the scan.

    With ``folded`` the lower-case columns come along: filters by place and industry then reach the scan.
    """
    schema = StructType([*LEAD_SCHEMA.fields, *(StructField(f, StringType()) for f in FOLDED.values() if folded)])
    paths = [f"{_data(root, v)}/bucket={b}" for b, v in sorted(read_manifest(spark, root, version).items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_lead(spark: SparkSession, root: str, version: int, lead_id: str) -> DataFrame:
    """One lead of a version: its id tells its bucket, the only one that is read."""
    bucket = spark.range(1).select(bucket_of(buckets_of(spark, root), F.lit(lead_id))).first()[0]
    return lookup_lead(read_snapshot(spark, root, version, [bucket]), lead_id)
