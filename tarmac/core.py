"""What every operator shares: tables, scratch tables that cut lineage, and iteration in rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark touches the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder; a cluster must name one, because a folder on
    one machine is out of the other executors' reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-scratch-")
    return _LOCAL_SCRATCH[app]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


#: Spark's setting by which the shuffle files of a query go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for how much one task reads of a shuffle, and our value where the session names none. Numbers pack tightly in
#: shuffle files, so Spark's own 64 MB are gigabytes in a task's sorts.
_PART, _PART_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is dropped by `at_exit`, when the driver ends."""
    return f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"


def at_exit(spark: SparkSession, path: str) -> None:
    """Drop a written path when the driver ends."""
    fs, where = _fs(spark, path)
    fs.deleteOnExit(where)


def materialise(df: DataFrame, *by: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """Write df to a scratch table in the shared folder, partitioned by the last columns `by`, and read it back.

    Lineage ends there: a lost executor costs a re-read of files instead of the whole history, and the columnar files
    are far smaller than checkpointed rows. The write's shuffle files go as soon as it has ended, so that long chains of
    steps don't pile them up. The folder goes when the driver ends; `release` drops it earlier. plain: columns such as hashes, whose
    values hardly repeat; they are written as they are, without the time that a try at a dictionary takes.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = {k: spark.conf.get(k, None) for k in (_CLEANUP, _PART)}
    spark.conf.set(_CLEANUP, "true")
    if before[_PART] is None:
        spark.conf.set(_PART, _PART_SIZE)
    try:
        df.write.partitionBy(*by).options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df, joined by shuffles of both sides wherever it is a side of an equality join.

    Spark takes a table's size from its files and doesn't count the rows that an explode makes, so columns of small numbers and
    exploded rows look a hundred times smaller than they are, and would go whole through the driver to be broadcast.
    """
    out = df.hint("merge")
    if path := getattr(df, "_scratch_path", None):
        out._scratch_path = path
    return out


def stored(df: DataFrame, *by: str) -> DataFrame:
    """materialise, for tables that grow with the input: joins shuffle them, however small their files are."""
    return shuffled(materialise(df, *by))


@contextmanager
def parted(spark: SparkSession) -> Iterator[None]:
    """Steps written in here may join sides that were repartitioned by a part of the join's keys as they lie, so that one shuffle of each
    side serves a join and the aggregation after it."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(df: DataFrame, part: str = "") -> None:
    """Drop the scratch table behind a DataFrame that `materialise` returned, once nothing reads it any more.

    part: drop only one partition, such as "slice=3"; the others can be read on from the same DataFrame.
    """
    path = getattr(df, "_scratch_path", None)
    if path:
        fs, where = _fs(df.sparkSession, f"{path}/{part}" if part else path)
        fs.delete(where, True)


def rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], bool]) -> DataFrame:
    """Apply step until changed(before, after) is false; every round's state is written, so plans stay short.

    The steps must move towards a fixed point; how many rounds that takes is the data's affair, so there is no cap.
    """
    now = stored(state)
    while True:
        after = stored(step(now))
        go_on = changed(now, after)
        release(now)
        now = after
        if not go_on:
            return now


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `place`, its rows' places from 0 in the given order: sorted by range, with one count for each partition sent to the
    driver. The result reads a scratch table."""
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    before, n = [], 0
    for k, size in sorted((r.part, r["count"]) for r in placed.groupBy(part.alias("part")).count().collect()):
        before += [F.lit(k).cast("long"), F.lit(n).cast("long")]
        n += size
    return placed.withColumn("place", F.create_map(*before)[part] + row) if n else placed


def ranked(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """df with `place`, its rows' places from 0 within their key in the given order, and `total`, the key's rows.

    One sort by range over all keys numbers the rows, and a key's first number is an aggregate: a key with most of the rows is spread
    over tasks as many small ones are. Null keys are left out.
    """
    placed = numbered(df.dropna(subset=key), *key, *order)
    first = materialise(placed.groupBy(*key).agg(F.min("place").alias("__first"), F.count("*").alias("total")))
    return placed.join(first, key).withColumn("place", F.col("place") - F.col("__first")).drop("__first")


def grid(*axes: tuple[str, int, int]) -> list[tuple[int, ...]]:
    """All integer offsets in the given closed ranges, as constants for small neighbourhoods."""
    out: list[tuple[int, ...]] = [()]
    for _, low, high in axes:
        out = [(*x, v) for x in out for v in range(low, high + 1)]
    return out


def offsets(name: str, pairs: list[tuple[int, int]]):
    """A column that explodes a constant list of (dx, dy)."""
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in pairs])).alias(name)
