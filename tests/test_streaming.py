"""The stream form of sessions gives what the table form gives, once the watermark has passed."""

import datetime as dt

from tarmac.streaming.sessions import batch_sessions, run_sessions, stream_sessions


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(k, t0 + dt.timedelta(seconds=s), float(s)) for k in (1, 2) for s in (0, 30, 90, 200, 5000 + k)] + [(9, t0 + dt.timedelta(days=1), 0.0)]
    obs = spark.createDataFrame(rows, "trace_id long, ts timestamp, x double")
    obs.write.parquet(str(tmp_path / "in"))
    stream = stream_sessions(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")), "1 minute", "10 minutes")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from sessions").collect()}
    want = {tuple(r) for r in batch_sessions(obs, "1 minute").where("trace_id <> 9").collect()}
    assert got == want and any(r[1] == 3 for r in want)


def test_late_rows_are_dropped_and_counted(spark):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    made = lambda rows: spark.createDataFrame([(k, t0 + dt.timedelta(seconds=s), float(s)) for k, s in rows], "trace_id long, ts timestamp, x double")
    first = made([(1, s) for s in (0, 30, 90, 5000)] + [(2, 20)])
    found, dropped = run_sessions([first, made([(1, 100), (3, 40), (1, 4990)]), made([(9, 99_999)])], "1 minute", "10 minutes")
    assert dropped == 2  # both are over ten minutes behind 5000; 4990 isn't, and joins its session
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in batch_sessions(first.union(made([(1, 4990)])), "1 minute").collect()}
