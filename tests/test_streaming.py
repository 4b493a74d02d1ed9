import datetime as dt

from pyspark.sql import functions as F

from linkgrain.operators.extract import declared_edges, marker_lines
from linkgrain.streaming import incremental


def test_index_replay_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def step(name, rows):
        spark.createDataFrame(rows, "path string, text string").coalesce(1).write.json(str(src / name))
        files = spark.readStream.schema("path string, text string").option("recursiveFileLookup", "true").json(str(src))
        incremental.index_stream(files, out, str(tmp_path / "cp")).awaitTermination()

    step("one", [("a.md", "# trace:v1 id=REQ-1 work=WORK-1"), ("b.md", "# trace:v1 id=REQ-2 work=WORK-1")])
    step("two", [("a.md", "# trace:v1 id=REQ-1 work=WORK-2")])
    got = sorted((r.path, r.f, r.t) for r in incremental.current_edges(spark, out).collect())
    full = spark.createDataFrame([("a.md", "# trace:v1 id=REQ-1 work=WORK-2"), ("b.md", "# trace:v1 id=REQ-2 work=WORK-1")], "path string, text string")
    assert got == sorted((r.path, r.f, r.t) for r in declared_edges(marker_lines(full)).collect())


def test_evidence_once_and_windows(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [("r", "t", "pass", at), ("r", "t", "pass", at), ("r", "u", "fail", at + dt.timedelta(minutes=90))]
    spark.createDataFrame(rows, "run_id string, framework_test_id string, outcome string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, framework_test_id string, outcome string, at timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", incremental.evidence_once(stream), "append"), ("windows", incremental.outcome_windows(stream), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    assert sorted((r.outcome, r.n) for r in spark.table("windows").collect()) == [("fail", 1), ("pass", 2)]


def test_obligations(spark, tmp_path):
    rows = [("a.py", "f", False), ("a.py", "f", True), ("a.py", "g", False)]
    spark.createDataFrame(rows, "path string, symbol string, traced boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, symbol string, traced boolean").parquet(str(tmp_path / "in"))
    incremental.obligations(stream).writeStream.format("memory").queryName("obligations").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = sorted(map(tuple, incremental.ledger(spark.createDataFrame(rows, "path string, symbol string, traced boolean").withColumn("at", F.lit(0))).collect()))
    assert sorted((r.path, r.symbol, r.state, r.events) for r in spark.table("obligations").collect()) == want


def test_obligations_with_a_time_end(spark, tmp_path):
    rows = [("a.py", "f", False, "2024-01-01 00:00:00"), ("a.py", "f", True, "2024-01-01 01:00:00"), ("a.py", "g", False, "2024-01-01 02:00:00")]
    events = spark.createDataFrame(rows, "path string, symbol string, traced boolean, at string").withColumn("at", F.col("at").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    incremental.obligations(stream, idle_ms=1000).writeStream.format("memory").queryName("timed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.path, r.symbol, r.state, r.events) for r in spark.table("timed").collect()) == [("a.py", "f", "satisfied", 2), ("a.py", "g", "pending", 1)]
