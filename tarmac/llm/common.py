"""Helpers that the operators share: Arrow batches in and out, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are handled together; long texts are bounded by Spark's own limit of bytes per batch.
SLICE = 256


def map_text(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run a function of (ids, texts) -> columns over every row of df, in Arrow batches inside the tasks.

    `make` is called once for a task, so that automata and models are built once. Null texts arrive as empty ones.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = work(part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; remainder 0 is held out from all learning."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled training documents, chosen by a hash of the id, one row each.

    Rows of the held-out fold, and null ids or labels, never enter. A document labelled more than once takes the
    largest label; an id that comes with several texts takes the least. The chosen ids are at most `rows` numbers, a proven
    bound, and so are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
