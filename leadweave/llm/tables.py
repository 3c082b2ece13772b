"""Tables in the shared folder, and fixed-size filters."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadweave.session import materialize

#: bits of the smallest and the largest filter: half a megabyte and 32
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(df: DataFrame, label: str) -> DataFrame:
    """The frame, written once to the folder in ``spark.checkpoint.dir`` and read back.

    The shuffle files of the write go with it: the table holds all that later steps read.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df, f"llm-{label}")
    finally:
        conf.set(key, before)


def delete_tables(*frames: DataFrame) -> None:
    """Remove tables made by :func:`table` that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for name in df.inputFiles()[:1]:
            path = context._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if path.getName().startswith("llm-"):
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """One bit for each value of ``pmod(column, bits)`` that occurs, as bytes.

    Sixteen bits a row, as far as MOST_BITS go: so few values pass by chance up to some ten million rows, and the more the more
    there are beyond. The bitmap is aggregated by Spark; rows of 4 KB reach the driver, 32 MB at most, however large the table is.
    A full bitmap only passes more rows on to the exact join behind it.
    """
    rows, bits = df.count(), LEAST_BITS
    while bits < MOST_BITS and bits < 16 * rows:
        bits *= 2
    bit = F.pmod(F.col(column), F.lit(bits))
    rows = (df.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(bit).alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect())
    # bucket k holds the values (k - 1) * 32768 + 1 .. k * 32768, bucket 0 the value 0 only: it shares the first bit of bucket 1
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = max(0, r["b"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[:bits // 8 - at]
        out[at:at + len(part)] |= part
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which int64 values the filter lets through."""
    at = np.maximum((values & np.int64(8 * len(bits) - 1)) - 1, 0)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def held_out(doc_id) -> F.Column:
    """Rows kept back from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
