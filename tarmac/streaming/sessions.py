"""Sessions of a GPS feed: the same aggregation over a stream, with a watermark, and over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.core import at_exit, scratch_path


def _sessions(obs: DataFrame, gap: str) -> DataFrame:
    rows = obs.groupBy("trace_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("x", "ts").alias("first_x"), F.max_by("x", "ts").alias("last_x"))
    return rows.drop("session_window")


def batch_sessions(obs: DataFrame, gap: str) -> DataFrame:
    """(trace_id, n, first_ts, last_ts, first_x, last_x): one row for each session; exactly one gap apart stays together."""
    return _sessions(obs, gap)


def stream_sessions(stream: DataFrame, gap: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """batch_sessions over a stream, for append mode: a session comes out once the watermark has passed it.

    Rows later than `late` behind the newest are dropped, as the watermark says.
    """
    return _sessions(stream.withWatermark("ts", late), gap)


def run_sessions(batches: list[DataFrame], gap: str = "1 minute", late: str = "10 minutes") -> tuple[DataFrame, int]:
    """The sessions that a stream over files puts out when these batches arrive one after the other, and how many rows came too late.

    Each batch is written to a folder that the stream watches, and the stream is started again from its checkpoint for what
    is new there; both folders and the sink lie in the shared folder. A session that the watermark hasn't passed after the last
    batch isn't put out. Late rows are counted as Spark counts them, after they are added up within a task.
    """
    spark = batches[0].sparkSession
    root, dropped = scratch_path(spark), 0
    for rows in batches:
        rows.write.mode("append").parquet(f"{root}/in")
        stream = stream_sessions(spark.readStream.schema(batches[0].schema).parquet(f"{root}/in"), gap, late)
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    at_exit(spark, root)
    return spark.read.schema(_sessions(batches[0], gap).schema).parquet(f"{root}/out"), dropped
