import time
from datetime import datetime, timedelta

from folioframe.operators.history import History
from folioframe.streaming import edits


def drain(query_of, spark, name):
    q = query_of.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


def test_history_stream(spark, tmp_path):
    src = str(tmp_path / "a")
    actions = [("s", i, ["commit", "undo", "redo", "commit"][i % 4]) for i in range(12)] + [("t", i, "commit") for i in range(3)]
    schema = "session_id string, seq long, action string"
    for k in range(0, len(actions), 5):  # several files, so state goes on between micro-batches
        spark.createDataFrame(actions[k : k + 5], schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.01)
    got = drain(edits.history_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)), spark, "history_out")
    want = {}
    for s in "st":
        h = History()
        for _, seq, a in [x for x in actions if x[0] == s]:
            h.apply(a)
            want[s, seq] = (h.past, h.future)
    assert {(r.session_id, r.seq): (r.undo_depth, r.redo_depth) for r in got} == want


def test_burst_and_rate_streams(spark, tmp_path):
    t, src = datetime(2024, 1, 1), str(tmp_path / "b")
    rows = [("s", "a", t), ("s", "a", t + timedelta(milliseconds=700)), ("s", "a", t + timedelta(seconds=5)), ("s", "b", t + timedelta(seconds=3600))]
    spark.createDataFrame(rows, "session_id string, kind string, ts timestamp").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("session_id string, kind string, ts timestamp").parquet(src)
    assert sorted(r.n for r in drain(edits.burst_stream(stream()), spark, "bursts_out")) == [1, 2]
    assert sum(r.n for r in drain(edits.change_rates(stream(), "1 minute", "1 minute"), spark, "rates_out")) == 3


def test_newest_requests(spark):
    df = spark.createDataFrame([("a", 5, 1), ("b", 2, 2), ("a", 1, 3), ("c", 1, 4)], "key string, priority int, seq int")
    assert [(r.key, r.newest, r.priority) for r in edits.newest_requests(df).collect()] == [("a", 3, 1), ("c", 4, 1), ("b", 2, 2)]
