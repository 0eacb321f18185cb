import random
from collections import defaultdict

from bibloom.operators import components, snapshots

SCHEMA = "row_id long, snapshot_no int, pmid string, doi string, title string, authors array<struct<name:string,first:boolean>>, delivered_at string, extra int"


def _brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    low = lambda x: None if x is None or x.strip().lower() in ("", "-", "n/a") else x.strip().lower()
    keys = {}
    for r in rows:
        p, d = low(r[2]), low(r[3])
        p = p and p.replace("pmid", "").lstrip("0")
        d = d and d.removeprefix("doi:").rstrip(".")
        keys[r[0]] = p, d
        if p and d:
            parent[find("p" + p)] = find("d" + d)
    out, by = set(), defaultdict(lambda: defaultdict(list))
    for r in rows:
        p, d = keys[r[0]]
        if p or d:
            content = (p, d, low(r[4]), tuple((low(a[0]), a[1]) for a in r[5] or ()), r[7])
            by[r[1]][find("p" + p if p else "d" + d)].append((content, r[0]))
    for s in range(min(by, default=0) + 1, max(by, default=0) + 1):
        a, b = by[s - 1], by[s]
        out |= {("added", min(i for _, i in b[k]), s) for k in b if k not in a}
        out |= {("removed", min(i for _, i in a[k]), s) for k in a if k not in b}
        out |= {("changed", min(i for _, i in b[k]), s) for k in b if k in a and {c for c, _ in a[k]} != {c for c, _ in b[k]}}
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        n = rnd.randrange(40)
        rows.append((i, rnd.randrange(1, 5), rnd.choice([None, "", "-", f"{n}7", f"PMID{n}7", f" 00{n}7 "]), rnd.choice([None, "N/A", f"10.1/a{n}", f"DOI:10.1/A{n}."]), rnd.choice(["t", "t", "T2", None, ""]), rnd.choice([None, [], [("a", True)], [("b", None), ("a", True)]]), str(i), rnd.choice([1, None])))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in snapshots.diff_snapshots(df).select("change_type", "row_id", "snapshot_no").collect()}
    assert got == _brute(rows)
    few = snapshots.diff_snapshots(df, rows_a_bucket=20)
    assert few.rdd.getNumPartitions() > 8 and {tuple(r) for r in few.drop("old_row_id").collect()} == got
    values = snapshots.changed_values(df, few, ("title", "extra")).collect()
    by = {r[0]: r for r in rows}
    assert len(values) == len(got)
    for v in values:
        assert (v["title"], v["extra"]) == ((None, None) if v["change_type"] == "removed" else (by[v["row_id"]][4], by[v["row_id"]][7]))
        assert (v["old_title"], v["old_extra"]) == ((None, None) if v["change_type"] == "added" else (by[v["old_row_id"]][4], by[v["old_row_id"]][7]))


def test_form_is_no_change(spark):
    rows = [(1, 1, "90", "10.1/A", "t", None, "x", 1), (2, 2, "PMID: 0090 ", "https://doi.org/10.1/a.", "t", [], "y", 1), (3, 2, None, None, "no key", None, "y", 1)]
    assert snapshots.diff_snapshots(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert snapshots.diff_snapshots(spark.createDataFrame([], SCHEMA)).count() == 0
    order = [(1, 1, "90", None, "t", [("a", True), ("b", True)], "x", 1), (2, 2, "90", None, "t", [("b", True), ("a", True)], "y", 1)]
    assert [r["change_type"] for r in snapshots.diff_snapshots(spark.createDataFrame(order, SCHEMA)).collect()] == ["changed"]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, None), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if v is not None:
            parent[find(u)] = find(v)
    got = {r["u"]: r["label"] for r in components.propagate(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == set(parent)
    assert len({(find(u), label) for u, label in got.items()}) == len(set(got.values())) == len({find(u) for u in parent})
    assert components.propagate(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_key_lookup(spark):
    from pyspark.sql import functions as F

    from bibloom.runtime import lookup

    big = spark.range(3000).withColumn("key", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id").cast("string")))
    small = big.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = lookup(big, small, "key", 3000)
    assert got.count() == 3000 and got.filter("key = 'hot' and low = 0").count() == 1000 and got.filter("low is null").count() == got.filter("key is null").count()
