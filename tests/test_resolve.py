import pytest
from pyspark.sql import functions as F

from helpers import TEXT_COLUMNS, bag, leads
from leadweave.fixed_values import LEAD_COLUMNS
from leadweave.operators import resolve as R
from leadweave.operators.topk import top_per_group
from leadweave.plans import fixtures as X


def now(day=1):
    return X.moment(f"2024-05-0{day} 00:00:00")


def rows_by_key(df):
    return {r.dedup_key: r for r in df.collect()}


def test_insert_then_backfill(spark):
    first = leads(spark, {"company_name": "Acme", "website": "https://acme.com", "email": "a@acme.com",
                          "confidence_score": 50})
    store = R.upsert_leads(R.empty_store(first), first, now(1))
    more = leads(spark, {"company_name": "Acme Co", "website": "https://www.acme.com/", "phone": "+201001234567",
                         "confidence_score": 90})
    lead = rows_by_key(R.upsert_leads(store, more, now(2)))["dom:acme.com"]
    assert (lead.company_name, lead.email, lead.phone) == ("Acme", "a@acme.com", "+201001234567")
    assert lead.confidence_score == 50 and lead.discovered_at.day == 1 and lead.updated_at.day == 2
    assert R.upsert_leads(store, more, now(2), rescore=True).first().confidence_score == 70
    again = R.upsert_leads(R.upsert_leads(store, more, now(2)), more, now(3)).first()
    assert again.updated_at.day == 2
    assert bag(R.upsert_counts(store, more), "inserted", "updated", "unchanged") == [(0, 1, 0)]


def test_row_actions_within_a_batch(spark):
    batch = leads(spark, {"website": "a.com"}, {"website": "a.com", "email": "x@a.com"},
                  {"website": "a.com", "email": "y@a.com"}, {"website": "a.com", "phone": "1", "email": "z@a.com"},
                  {"company_name": "N", "city": "C"}, {"company_name": "n ", "city": "c"})
    acts = bag(R.upsert_actions(R.empty_store(batch), batch), "ord", "action")
    assert [a for _, a in acts] == ["inserted", "updated", "unchanged", "updated", "inserted", "unchanged"]


def test_nameless_siteless_rows_do_not_merge(spark):
    batch = leads(spark, {"description": "one"}, {"description": "two"})
    assert R.upsert_leads(R.empty_store(batch), batch, now()).count() == 2


def sequential_upsert(rows):
    """The rules, row by row in Python: key -> (values, actions)."""
    store, actions = {}, []
    for key, row in rows:
        if key not in store:
            store[key] = dict(row)
            actions.append("inserted")
            continue
        fresh = [c for c in TEXT_COLUMNS if row[c] and not store[key][c]]
        store[key].update({c: row[c] for c in fresh})
        actions.append("updated" if fresh else "unchanged")
    return store, actions


def test_upsert_equals_sequential_rules(spark, sf):
    graded = X.grade_leads(X.raw_leads(spark, sf))
    keyed = R.key_leads(graded).orderBy("ord").collect()
    store, actions = sequential_upsert([(r.dedup_key, r.asDict()) for r in keyed])
    snap = rows_by_key(R.upsert_leads(R.empty_store(graded), graded, now()))
    assert set(snap) == set(store)
    assert all(snap[k][c] == store[k][c] for k in store for c in TEXT_COLUMNS)
    got = [a for _, a in bag(R.upsert_actions(R.empty_store(graded), graded), "ord", "action")]
    assert got == actions


def sequential_dedup(rows):
    domains, names, out = {}, set(), []
    for dom, name, row in rows:
        if dom and dom in domains:
            for c in TEXT_COLUMNS:
                domains[dom][c] = domains[dom][c] or row[c]
            continue
        if name and name in names and not dom:
            continue
        row = dict(row)
        if dom:
            domains[dom] = row
        if name:
            names.add(name)
        out.append(row)
    return out


def test_dedup_equals_sequential_rules(spark, sf):
    raw = X.raw_leads(spark, sf).withColumn("d", R.domain(F.col("website")))
    rows = [(r.d, r.company_name.lower(), r.asDict()) for r in raw.orderBy("ord").collect()]
    want = sorted(tuple(r[c] for c in ("ord", *TEXT_COLUMNS)) for r in sequential_dedup(rows))
    assert bag(R.dedup_candidates(raw.drop("d")), "ord", *TEXT_COLUMNS) == want


def test_dedup_name_of_merged_duplicate_is_not_remembered(spark):
    df = leads(spark, {"company_name": "A", "website": "a.com"}, {"company_name": "B", "website": "www.a.com"},
               {"company_name": "B"}, {"company_name": "a"}, {}, {})
    assert [o for o, in bag(R.dedup_candidates(df), "ord")] == [0, 2, 4, 5]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_result_does_not_depend_on_partitioning(spark, sf, partitions):
    graded = X.grade_leads(X.raw_leads(spark, sf))
    base = bag(R.upsert_leads(R.empty_store(graded), graded, now()).drop("updated_at"), *[
        c for c in LEAD_COLUMNS if c != "updated_at"])
    cut = graded.repartition(partitions, F.rand(7))
    got = R.upsert_leads(R.empty_store(cut), cut, now()).drop("updated_at")
    assert bag(got, *[c for c in LEAD_COLUMNS if c != "updated_at"]) == base


def test_hot_key_and_hot_group(spark):
    rows = spark.range(0, 30000, 1, 16).selectExpr(
        "id as ord", "if(id % 3 = 0, 'hot.com', concat('s', id % 5000, '.com')) as website",
        "if(id % 100 = 99, concat('u', id), '') as email")
    batch = X.conform(rows)
    counts = R.upsert_counts(R.empty_store(batch), batch).first()
    n_keys = batch.select("website").distinct().count()
    assert counts.inserted == n_keys and counts.inserted + counts.updated + counts.unchanged == 30000
    hot = R.upsert_leads(R.empty_store(batch), batch, now()).filter("dedup_key = 'dom:hot.com'").first()
    assert hot.email == "u99"

    top = bag(top_per_group(rows, ["website"], ["ord"], 3, rank="r"), "website", "ord", "r")
    by = {}
    for r in rows.collect():
        by.setdefault(r.website, []).append(r.ord)
    assert top == sorted((k, o, i + 1) for k, v in by.items() for i, o in enumerate(sorted(v)[:3]))
    limited = rows.withColumn("lim", F.when(F.col("website") == "hot.com", 700).otherwise(2))
    got = top_per_group(limited, ["website"], ["ord"], F.col("lim")).groupBy("website").count()
    assert dict(tuple(r) for r in got.collect())["hot.com"] == 700


def test_delete(spark, sf):
    table = X.leads(spark, sf)
    one = table.select("lead_id").limit(1)
    gone = one.first().lead_id
    left = R.delete_leads(table, table.filter(F.col("lead_id") == gone))
    assert left.filter(F.col("lead_id") == gone).isEmpty() and left.count() < table.count()
