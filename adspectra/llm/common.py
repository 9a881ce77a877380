"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adspectra.sources.session import ship

#: Prefix of every column an operator adds to a caller's table for its own use.
OWN = "__asx_"
#: Rows whose texts are taken out of an Arrow batch at once.
ROWS = 256
#: Settings under which Spark removes a finished query's shuffle files.
SHUFFLE_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode only, a temporary folder where it is unset."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if jsc.getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if jsc.getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="adspectra-checkpoints-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so that losing an executor never repeats the work above."""
    shared_folder(spark_of(df))
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Has Spark remove the shuffle files of each query that runs inside, once that query is over."""
    before = {k: spark.conf.get(k, None) for k in SHUFFLE_CLEANUP}
    try:
        for k in SHUFFLE_CLEANUP:
            spark.conf.set(k, "true")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table, which takes less room; the shuffle files that led to it go at once.

    The table goes by ``dropped``, or when the driver's process ends.
    """
    spark = spark_of(df)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        _remove(spark_of(df), df.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone, and its folder with it
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], rank: str, spread: Column) -> DataFrame:
    """Adds ``rank``: a gapless number from 0 within the rows of equal ``keys``.

    No key is numbered by one task: each key's rows are dealt into buckets by ``spread``, numbered
    within the bucket, and moved on by the sizes of the buckets before it.  ``df`` is read twice.
    """
    b, n, o = f"{OWN}bucket", f"{OWN}n", f"{OWN}offset"
    dealt = df.withColumn(b, F.pmod(spread, F.lit(partitions(spark_of(df)))).cast("int"))
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(o))
    numbered = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)).cast("long") - 1)
    return numbered.join(offsets, [*keys, b]).withColumn(rank, F.col(rank) + F.col(o)).drop(b, o)


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows.

    A batch may hold all texts of a task; taken out at once, they and what is worked out of them would stand in memory beside it.
    """
    for batch in batches:
        for row in range(0, batch.num_rows, rows):
            yield batch.slice(row, rows)


def raw(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
