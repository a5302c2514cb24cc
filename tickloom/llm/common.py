"""Expressions and helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, tab to carriage return and the blank, as a Java pattern.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, whatever number of times the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table just read, over at least as many partitions as the cluster has cores: for operators to which a row costs far more
    work than its way to another task.

    A table that comes in fewer partitions, such as one file with a single row group, which Spark reads in one task, is dealt anew;
    any other stays as it is. Only the order of rows can change.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it where a column of df has it; for columns that an operator adds on its way."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset in local mode, as in tests, the warehouse folder serves; a cluster must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir")


#: Where the tables of materialized frames lie.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: later steps neither recompute it nor need its lineage.

    The table outlives lost executors. It stays until ``release`` or until the folder is cleaned. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tickloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Jobs that are started inside send Arrow batches of about ``size`` to Python, so that an executor's memory doesn't depend on
    how long the texts of Spark's 10,000 rows are. A session with a size of its own keeps it; a longer row comes alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    if own is None:
        spark.conf.set(name, size)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``materialize`` returned, once nothing lazy reads them any more."""
    for df in frames:
        path = _paths.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
