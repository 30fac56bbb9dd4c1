from conftest import SMALL

from helixframe.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    s = events.windowed(events.stream_table(spark, str(tmp_path / "in" / "*"), batch.schema))
    q = s.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((str(r["start"]), r["event_type"], r["n"], r["total"]) for r in rows)
    assert key(spark.table("w").collect()) == key(events.windowed(batch).collect())
