import glob
import json
import re

from pyspark.sql import functions as F

from helpers import bag, leads
from leadweave.fixed_values import LEAD_COLUMNS
from leadweave.operators import query as Q, resolve as R
from leadweave.plans import fixtures as X, report
from leadweave.plans.catalog import run_scan_ticks, run_ticks
from leadweave.schema import EXPORT_COLUMNS
from leadweave.session import scratch_dir
from leadweave.sources import sinks
from leadweave.streaming import ticks
from leadweave.streaming.upsert import stream_upsert, upsert_batch
from test_plans import plan


def test_stream_equals_batch_and_replay_changes_nothing(spark, sf):
    root = scratch_dir(spark, "stream-test")
    version = run_ticks(spark, sf, root, ticks=2)
    assert version == 2
    store, batch = X.store_and_batch(spark, sf)
    ordered = batch.withColumn("ord", F.col("ord") % 2 * 10 ** 9 + F.col("ord"))
    want = bag(R.upsert_leads(store, ordered, X.moment(X.BATCH_NOW)), *LEAD_COLUMNS)
    snapshot = sinks.read_snapshot(spark, f"{root}/leads", version)
    assert bag(snapshot, *LEAD_COLUMNS) == want
    # the last micro-batch once more, as after a failure between write and commit
    upsert_batch(spark, f"{root}/leads", X.moment(X.BATCH_NOW), ("ord",))(batch.filter("ord % 2 = 1"), 1)
    assert bag(sinks.read_snapshot(spark, f"{root}/leads", version), *LEAD_COLUMNS) == want
    # a tick without new files makes no new version
    assert stream_upsert(spark, f"{root}/landing/*", batch.schema, f"{root}/leads", f"{root}/checkpoint",
                         X.moment(X.BATCH_NOW)) <= version
    assert len(glob.glob(f"{root}/leads/manifest/v=*")) == 3


def test_a_tick_with_one_key_rewrites_one_bucket(spark, sf):
    root = scratch_dir(spark, "buckets")
    store, batch = X.store_and_batch(spark, sf)
    sinks.write_snapshot(store, root, 0)
    one = batch.filter("email <> ''").limit(1)
    upsert_batch(spark, root, X.moment(X.BATCH_NOW), ("ord",))(one, 0)
    assert len(glob.glob(f"{root}/data/v=000000001/bucket=*")) == 1
    before, after = sinks.read_manifest(spark, root, 0), sinks.read_manifest(spark, root, 1)
    assert sum(after.get(b) != v for b, v in before.items()) <= 1 and 1 in after.values()
    want = bag(R.upsert_leads(store, one, X.moment(X.BATCH_NOW)), *LEAD_COLUMNS)
    assert bag(sinks.read_snapshot(spark, root, 1), *LEAD_COLUMNS) == want


def test_csv_round_trip_with_awkward_text(spark):
    df = leads(spark, {"company_name": 'A "quoted", name', "description": "two\nlines \\ and ' more", "city": " x "}, {})
    path = scratch_dir(spark, "csv")
    sinks.export_leads_csv(df, path)
    assert bag(sinks.read_leads_csv(spark, path), *EXPORT_COLUMNS) == bag(df, *EXPORT_COLUMNS)


def test_history_keeps_the_latest(spark):
    runs = spark.range(250).selectExpr("cast(1000 + id as string) as started_at", "id as discovered")
    kept = sinks.append_scan_history(runs.filter("id < 100"), runs.filter("id >= 100"))
    assert kept.count() == 200 and kept.agg(F.min("discovered")).first()[0] == 50
    tied = spark.range(9).selectExpr("'x' as started_at", "id as discovered")
    assert bag(sinks.append_scan_history(None, tied, 3), "discovered") == bag(sinks.append_scan_history(tied.filter("discovered % 2 = 0"), tied.filter("discovered % 2 = 1"), 3), "discovered")


def test_report_files(spark, sf):
    path, as_of = scratch_dir(spark, "report"), X.moment(X.AS_OF)
    rep = report.period_report(X.leads(spark, sf), as_of, 7)
    lines, doc = report.write_report(rep, as_of, 7, path)
    text = [r.value for r in spark.read.text(lines).collect()]
    assert text[0] == "Leads — Weekly Report" and text[4] == "" and text[5] == "Totals"
    assert "  New leads this period    : 259" in text and text[-1] == ""
    facts = json.loads(spark.read.text(doc).first().value)
    assert facts["totals"]["missing_contact"] == 125 and len(facts["sample_new"]) == 10
    assert facts["period_start"] == "2024-02-03T00:00:00+00:00"


def test_top_values_breaks_ties_by_first_in_rank_order(spark):
    df = leads(spark, *[{"company_name": n, "city": c, "confidence_score": s, "dedup_key": n} for n, c, s in (
        ("a", "X", 10), ("b", "Y", 90), ("c", " Y ", 20), ("d", "X", 15), ("e", "Z", 99), ("f", "", 100))])
    assert bag(Q.top_values(df, ["city"], 2), "pos", "value", "n") == [(1, "Y", 2), (2, "X", 2)]


def test_search_filters(spark):
    df = leads(spark, {"company_name": "A", "industry": "Dental & Healthcare", "city": "Asyut", "country": "Egypt",
                       "source_url": "https://a_b.com"},
               {"company_name": "B", "category": "automotive", "city": "Cairo", "country": "Egypt", "confidence_score": 60,
                "source_url": "https://axb.com"})
    assert bag(Q.search_leads(df, industry="dental & healthcare"), "company_name") == [("A",)]
    assert bag(Q.search_leads(df, industry="Automotive", city="CAIRO", min_score=60), "company_name") == [("B",)]
    assert Q.search_leads(df, country="egypt").count() == 2 and Q.search_leads(df).count() == 2
    assert Q.search_leads(df, source="A_B").count() == 2 and Q.search_leads(df, source="\\").count() == 0
    assert bag(Q.search_leads(df, keyword="AUTO"), "company_name") == [("B",)]


def test_source_host_facet_keeps_schemeless_values(spark):
    df = leads(spark, *[{"source_url": u} for u in ("https://www.A.com/x", "http://a.com/y", "www.b.com/z", "")])
    assert bag(Q.facet_source_host(df), "value", "n") == [("a.com", 2), ("b.com/z", 1)]
    assert bag(Q.facet_source_host(df, 1, fold_top_urls=True), "n") == [(1,)]


def test_empty_table(spark):
    df = X.conform(spark.createDataFrame([], "ord long"))
    assert Q.avg_score(df).first().avg_score == 0.0
    assert Q.counts_since(df, X.moment(X.AS_OF)).first().asDict()["total"] == 0


def test_a_scan_tick_is_safe_to_run_again(spark, sf):
    root = scratch_dir(spark, "ticks")
    version = run_scan_ticks(spark, sf, root)
    read = lambda: (bag(sinks.read_snapshot(spark, f"{root}/leads", version), *LEAD_COLUMNS), ticks.read_history(spark, root, version).collect(),
                    spark.read.text(f"{ticks.report_path(root, version)}/text").collect(), spark.read.text(f"{ticks.report_path(root, version)}/json").collect())
    leads, history, lines, doc = read()
    assert version == 2 and [r.searches for r in history] == sorted((r.searches for r in history), reverse=True) or len(history) == 2
    assert all(r.inserted + r.updated + r.unchanged == r.discovered > 0 and r.started_at.startswith("2024-03-02") for r in history)
    assert lines[0].value.endswith("Daily Report") and '"period_label":"Daily"' in doc[0].value
    # the last tick once more, as after a failure between write and commit
    last = spark.read.schema(ticks.REQUEST_SCHEMA).parquet(f"{root}/requests/tick=1")
    ticks.scan_tick(root, X.scan_inputs(spark, sf))(last, 1)
    assert read() == (leads, history, lines, doc)


def test_a_lead_is_read_from_its_own_bucket(spark, sf):
    root = scratch_dir(spark, "lookup")
    store, _ = X.store_and_batch(spark, sf)
    sinks.write_snapshot(store, root, 0, buckets=16)
    assert sinks.buckets_of(spark, root) == 16
    one = store.filter("city <> ''").orderBy("dedup_key").first()
    found = sinks.read_lead(spark, root, 0, one.lead_id)
    assert [r.dedup_key for r in found.collect()] == [one.dedup_key]
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert sinks.read_lead(spark, root, 0, "none").collect() == []
    folded = sinks.read_snapshot(spark, root, 0, folded=True)
    text = plan(Q.filter_equal(folded, "city", "CAIRO"), "formatted")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(city_folded,cairo\)", text)
    city = one.city.upper()
    assert bag(Q.search_leads(folded, city=city), "lead_id") == bag(Q.search_leads(store, city=city), "lead_id") != []
    assert Q.search_leads(folded, city=city, industry="x").columns == sinks.read_snapshot(spark, root, 0).columns
