from collections import defaultdict

from leadweave.llm.line_dedup import remove_boilerplate


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    key = lambda d: (d is None, d or 0)
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            line = line.strip(" \t\r\f\v")
            if line:
                sites[line] |= {s} - {None}
                first[line] = min(first.get(line, d), d, key=key)
    out = []
    for d, t, s in rows:
        lines = t.split("\n") if t is not None else []
        keep = [x for x in lines if (y := x.strip(" \t\r\f\v")) == "" or len(sites[y]) < min_sites or first[y] == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep) if t is not None else None))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = [(i, f"own {i}\n banner\t\nnear {i % 3}\n\nrare {i % 5}", f"s{i % 9}") for i in range(60)]
    rows += [(i, "eight only\nseven only", f"t{i % 8}" if i < 990 else None) for i in range(982, 994)]
    rows += [(500 + i, "seven sites", f"t{i % 7}") for i in range(40)]
    rows += [(7, "repeated row\nbanner", "s1")] * 2 + [(None, "banner\nnull id", None), (3, None, "s1"), (4, "", "s1"), (9, "banner\n" * 5000, "s2")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, key int, places string")
    got = sorted((tuple(r) for r in df.transform(remove_boilerplate).select("doc_id", "n_lines", "n_removed", "kept_text").collect()), key=str)
    assert got == brute(rows, 8)
    assert sum(r[2] for r in got) > 100
    assert remove_boilerplate(df.where("false")).collect() == []
