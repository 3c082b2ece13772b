"""Crawled pages as a table bucketed by the hash of their canonical URL.

The table is written once for a crawl, and that is the only time its HTML is moved. From then on, whether a page is needed is
decided by its URL, which is one narrow column, and a join on the URL reads each bucket where it lies.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import with_canonical_url
from ..session import scratch_dir

_SCHEMA = "page_url string, page_id bigint, html string"


def write_page_store(pages: DataFrame, root: str, buckets: int | None = None) -> DataFrame:
    """Store pages (page_id, url, html) below ``root``, a new folder, and open the store.

    Choose ``buckets`` so that one holds some hundred megabytes of HTML; without it there are as many as shuffle partitions.
    Pages whose URL has no canonical form are left out; several of one URL are all kept.
    """
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_canonical_url(pages.select("page_id", "url", "html"), "url", "page_url").filter(F.col("page_url") != "")
    name = _name(root)
    # dealt out as the buckets are: each task writes the files of its own ones only
    (rows.select("page_url", F.col("page_id").cast("long").alias("page_id"), "html").repartition(buckets, "page_url").sortWithinPartitions("page_url", "page_id")
     .write.format("parquet").bucketBy(buckets, "page_url").sortBy("page_url", "page_id").option("path", _data(root)).saveAsTable(name))
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{root.rstrip('/')}/layout")
    return spark.table(name)


def open_page_store(spark: SparkSession, root: str) -> DataFrame:
    """The stored pages (page_url, page_id, html), in any session that reaches the folder."""
    name = _name(root)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.schema("buckets int").parquet(f"{root.rstrip('/')}/layout").first()["buckets"]
        path = _data(root).replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({_SCHEMA}) USING parquet CLUSTERED BY (page_url) SORTED BY (page_url, page_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def stored(pages: DataFrame) -> DataFrame:
    """Pages as a store: those of a store as they are, others written to the shared folder first."""
    return pages if "page_url" in pages.columns else write_page_store(pages, scratch_dir(pages.sparkSession, "page-store"))


def needed_pages(store: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages (page_url, page_id, html) at the URLs (page_url); of several with one URL the lowest id.

    Two scans: the first reads URLs and ids alone and finds the rows, the second reads the HTML of their buckets. The stored side
    of both joins lies in its buckets as it is; the needed URLs are dealt out to them and held as the hash table.
    """
    wanted = urls.select("page_url").distinct()
    first = (store.select("page_url", "page_id").join(wanted.hint("shuffle_hash"), "page_url", "left_semi")
             .groupBy("page_url").agg(F.min("page_id").alias("_first")).withColumnRenamed("page_url", "_url"))
    # no other id is below the lowest, and an inequality is no join key: the buckets, which are of the URL, stay as they are
    chosen = store.join(first.hint("shuffle_hash"), (F.col("page_url") == F.col("_url")) & (F.col("page_id") <= F.col("_first")))
    return chosen.select("page_url", "page_id", "html")


def _name(root: str) -> str:
    return f"page_store_{hashlib.md5(root.rstrip('/').encode()).hexdigest()}"


def _data(root: str) -> str:
    return f"{root.rstrip('/')}/data"
