"""Lines that spread over many sites: HyperLogLog sketches first, exact counts near the threshold.

Sketches of the sites of each line's 128-bit hash are merged by aggregation, in the map tasks first, so a line on a third
of all pages is no hot group. Lines whose estimate lies near the threshold get an exact distinct count. A boilerplate line
stays in the document of smallest id that holds it, so no content leaves the corpus, and goes everywhere else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadweave.llm.tables import table
from leadweave.llm.words import slices

MIN_SITES = 8
#: 2 ** 12 registers: a relative standard error of 1.04 / 64
SKETCH = 12
BLANK = " \t\r\f\v"


def margin(sites: int) -> float:
    """Distance from the threshold beyond which an estimate is taken as it is: one site and six standard errors."""
    return 1 + 6 * sites * 1.04 / 2 ** (SKETCH / 2)


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(l1, l2, first): lines of (id, site, l1, l2) on min_sites sites or more, and the smallest id of each."""
    wide = (lines.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(SKETCH)).alias("sketch"), F.min("id").alias("first"))
            .where(F.col("n") >= min_sites).select("l1", "l2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
            .where(F.col("sites") >= min_sites - margin(min_sites)))
    wide = table(wide, "wide")
    sure = F.col("sites") >= min_sites + margin(min_sites)
    near = wide.where(~sure)
    exact = (lines.join(near.select("l1", "l2"), ["l1", "l2"], "left_semi").groupBy("l1", "l2").agg(F.countDistinct("site").alias("n"))
             .where(F.col("n") >= min_sites))
    return wide.where(sure).select("l1", "l2", "first").unionByName(near.join(exact, ["l1", "l2"], "left_semi").select("l1", "l2", "first"))


def _drop(batches):
    for batch in slices(batches, "text"):
        total, gone, kept = [], [], []
        for text, places in zip(batch.column(1), batch.column(2)):
            lines = text.as_py().split("\n") if text.is_valid else []
            out = set(np.asarray(places.values).tolist()) if places.is_valid else set()
            total.append(len(lines))
            gone.append(len(out))
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in out) if text.is_valid else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), batch.column(3)],
                                         names=["id", "n_lines", "n_removed", "kept_text", "carried"])


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text_column: str = "text",
                       site_column: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, kept_text.

    Lines end at a line feed and are compared without blanks at their ends; blank lines stay. A line goes if it is on
    min_sites distinct sites or more, but from the document(s) of the smallest id that holds it. Null sites count as no
    site; a null text has no lines and stays null; null ids come after all others. Repeated rows are treated alike.
    Columns named in ``carry`` come along as a struct ``carried``, others are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(site_column).cast("string").alias("site"),
                       F.struct(*(carry or [id_column])).alias("carried"))
    docs = docs.withColumn("key", F.xxhash64("id", "text"))
    line = F.trim("line", F.lit(BLANK))
    lines = (docs.select("key", "id", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
             .select("key", "id", "site", "place", line.alias("line")).where("line <> ''")
             .select("key", "id", "site", "place", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), "line").alias("l2")))
    found = table(boilerplate(lines.select("id", "site", "l1", "l2"), min_sites), "lines")
    # a document's places: as many as it has lines at most
    places = (lines.join(found, ["l1", "l2"]).where(~F.col("id").eqNullSafe(F.col("first")))
              .groupBy("key", F.col("id").alias("of")).agg(F.collect_set("place").alias("places")))
    places = table(places.withColumnRenamed("key", "text_key"), "places")
    joined = docs.join(places, (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("of")), "left")
    types = dict(docs.dtypes)
    out = (joined.select("id", "text", "places", "carried")
           .mapInArrow(_drop, f"id {types['id']}, n_lines long, n_removed long, kept_text string, carried {types['carried']}").withColumnRenamed("id", id_column))
    return out if carry else out.drop("carried")
