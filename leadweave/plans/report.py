"""Period reports as long rows, one JSON struct, or text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import HEADINGS, SECTIONS, TOTALS
from ..operators.query import (canonical_order, counts_since, leads_since, top_values, topk_missing,
                               topk_new)
from ..session import materialize

def period_start(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {days} DAYS")


def period_label(days: int) -> str:
    return "Weekly" if days >= 7 else "Daily"


def _sampled(df: DataFrame, section: str) -> DataFrame:
    """At most ten rows, numbered in canonical order."""
    pos = F.row_number().over(Window.orderBy(*canonical_order()))
    return df.select(
        F.lit(section).alias("section"), pos.cast("int").alias("pos"),
        F.col("company_name").alias("name"), "city", "website",
        F.col("confidence_score").cast("bigint").alias("n"))


def period_report(df: DataFrame, as_of: Column, days: int = 1, top: int = 5,
                  sample: int = 10) -> DataFrame:
    """All report facts as rows (section, pos, name, city, website, n).

    Three passes with few columns each; what comes out of each pass is bounded by the report
    itself (counters, top lists, samples).
    """
    since = period_start(as_of, days)
    blank = F.lit("")
    counters = counts_since(df, since).select(F.posexplode(F.array(*[
        F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in TOTALS])).alias("pos", "t"))
    totals = counters.select(F.lit("totals").alias("section"), (F.col("pos") + 1).cast("int").alias("pos"),
                             "t.name", blank.alias("city"), blank.alias("website"), "t.n")
    tops = top_values(leads_since(df, since), ["industry", "city"], top).select(
        F.when(F.col("attr") == "industry", "top_industries").otherwise("top_cities").alias("section"),
        F.col("pos").cast("int").alias("pos"), F.col("value").alias("name"),
        blank.alias("city"), blank.alias("website"), "n")
    new = _sampled(topk_new(df, since, sample), "sample_new")
    missing = _sampled(topk_missing(df, sample), "sample_missing_contact")
    return totals.unionByName(tops).unionByName(new).unionByName(missing)


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def report_json(report: DataFrame, as_of: Column, days: int, label: str | None = None) -> DataFrame:
    """The report as one JSON document (a few dozen bounded rows become one)."""
    def rows(section: str, *fields: Column) -> Column:
        packed = F.sort_array(F.collect_list(F.when(
            F.col("section") == section, F.struct("pos", F.struct(*fields).alias("r")))))
        return F.transform(packed, lambda x: x["r"])

    def counts(section: str) -> Column:
        entries = rows(section, F.col("name").alias("key"), F.col("n").alias("value"))
        return F.map_from_entries(entries)

    facts = report.agg(
        counts("totals").alias("totals"), counts("top_industries").alias("top_industries"),
        counts("top_cities").alias("top_cities"),
        rows("sample_new", F.col("name").alias("company"), F.col("city"),
             F.col("n").alias("score")).alias("sample_new"),
        rows("sample_missing_contact", F.col("name").alias("company"), F.col("city"),
             F.col("website")).alias("sample_missing_contact"))
    return facts.select(F.to_json(F.struct(
        F.lit(label or period_label(days)).alias("period_label"),
        _iso(period_start(as_of, days)).alias("period_start"),
        _iso(as_of).alias("generated_at"), "*")).alias("value"))


def report_lines(report: DataFrame, as_of: Column, days: int, label: str | None = None,
                 title: str = "Leads") -> DataFrame:
    """The report as text lines (section, pos, line); sort by section and pos to print."""
    shown = F.when(F.col("name") == "", "(unknown)").otherwise(F.col("name"))
    labels = F.create_map(*[F.lit(x) for kv in TOTALS.items() for x in kv])
    s = F.col("section")
    line = (F.when(s == "totals", F.format_string("  %s: %d", labels[F.col("name")], "n"))
            .when(s.isin("top_industries", "top_cities"), F.format_string("  %s: %d", shown, "n"))
            .when(s == "sample_new", F.format_string("  - %s  [%s]  score=%d", "name", "city", "n"))
            .otherwise(F.format_string("  - %s  [%s]  %s", "name", "city", "website")))
    number = F.array_position(F.array(*[F.lit(x) for x in SECTIONS]), s).cast("int")
    body = report.select(number.alias("section"), F.col("pos"), line.alias("line"))

    spark = report.sparkSession
    fixed = [(0, 4, "=" * 50), (len(SECTIONS) + 1, 0, "")]
    for i, heading in enumerate(HEADINGS, start=1):
        fixed += [(i, -2, ""), (i, -1, heading), (i, 0, "-" * 50)]
    frame = spark.createDataFrame(fixed, "section int, pos int, line string")
    head = spark.range(1).select(F.posexplode(F.array(
        F.lit(f"{title} — {label or period_label(days)} Report"),
        F.concat(F.lit("Period start : "), _iso(period_start(as_of, days))),
        F.concat(F.lit("Generated at : "), _iso(as_of)))).alias("pos", "line")).select(
        F.lit(0).alias("section"), (F.col("pos") + 1).cast("int").alias("pos"), "line")
    return body.unionByName(frame).unionByName(head)


def write_report(report: DataFrame, as_of: Column, days: int, path: str,
                 label: str | None = None) -> tuple[str, str]:
    """Write the text and JSON forms (some dozen lines each); returns their paths. The report is computed once."""
    report = materialize(report, "report")
    lines, doc = f"{path}/text", f"{path}/json"
    (report_lines(report, as_of, days, label).orderBy("section", "pos").select("line")
     .coalesce(1).write.mode("overwrite").text(lines))
    report_json(report, as_of, days, label).coalesce(1).write.mode("overwrite").text(doc)
    return lines, doc
