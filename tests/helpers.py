"""Small frames for unit tests."""

from pyspark.sql import functions as F

from leadweave.schema import LEAD_SCHEMA, TEXT_COLUMNS, conform


def evaluate(spark, fn, values, type_="string"):
    """fn(column) for every value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    rows = df.select("i", fn(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def leads(spark, *rows):
    """Lead rows from keyword dicts; ord defaults to the position."""
    names = sorted({k for r in rows for k in r} | {"ord"})
    types = {f.name: f.dataType.simpleString() for f in LEAD_SCHEMA.fields} | {"ord": "bigint", "search_id": "bigint"}
    data = [tuple(({"ord": i} | r).get(n, "" if types[n] == "string" else None) for n in names)
            for i, r in enumerate(rows)]
    return conform(spark.createDataFrame(data, ", ".join(f"{n} {types[n]}" for n in names)))


def bag(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


__all__ = ["TEXT_COLUMNS", "bag", "evaluate", "leads"]
