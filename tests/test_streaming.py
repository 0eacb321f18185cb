from pyspark.sql import functions as F

from bibloom.streaming import fresh

SCHEMA = "k string, ts timestamp, v double"


def _stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, ts string, v double").select("k", F.col("ts").cast("timestamp"), "v").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def _run(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


ROWS = [[("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:00:00", 5.0)], [("a", "2024-01-02 00:00:00", 2.0), ("a", "2024-01-01 12:00:00", 9.0)], [("b", "2023-12-31 23:00:00", 7.0)]]


def test_newest(spark, tmp_path):
    last = {}
    for r in _run(fresh.newest(_stream(spark, tmp_path, ROWS), ["k"], "ts", "v"), "update", "newest", tmp_path):
        if r["k"] not in last or r["ts"] > last[r["k"]][0]:
            last[r["k"]] = r["ts"], r["v"]
    assert {k: v for k, (_, v) in last.items()} == {"a": 2.0, "b": 5.0}


def test_distinct_and_windows(spark, tmp_path):
    assert sorted(r["k"] for r in _run(fresh.distinct_within(_stream(spark, tmp_path, ROWS), ["k"], "ts"), "append", "firsts", tmp_path)) == ["a", "b"]
    got = _run(fresh.active_windows(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), ["k"], "ts"), "complete", "windows", tmp_path)
    assert sum(r["n"] for r in got) == 5


def test_state_is_let_go(spark, tmp_path):
    rows = [[("a", "2024-01-01 00:00:00", 1.0)], [("b", "2024-03-01 00:00:00", 2.0)], [("b", "2024-06-01 00:00:00", 3.0)], [("a", "2024-01-02 00:00:00", 9.0), ("b", "2024-06-01 00:00:00", 4.0)]]
    df = fresh.newest(_stream(spark, tmp_path, rows), ["k"], "ts", "v", "5 days")
    q = df.writeStream.outputMode("update").format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "c_gone")).start()
    q.processAllAvailable()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = [(r["k"], r["v"]) for r in spark.table("gone").collect()]
    assert kept == 1 and ("a", 9.0) not in got and got[-1] == ("b", 4.0)
