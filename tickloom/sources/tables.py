"""The stored tables: their columns, creation, and the sinks of statistics and rows as JSON."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.payloads import current, replace_json

_BAR = "id INT, date DATE NOT NULL, open_price DOUBLE, high_price DOUBLE, low_price DOUBLE, close_price DOUBLE NOT NULL"
_STAMPS = "created_at TIMESTAMP, updated_at TIMESTAMP"
TABLES = {
    "gold_prices": f"{_BAR}, volume INT, change_percent DOUBLE, {_STAMPS}",
    "dollar_index": f"{_BAR}, {_STAMPS}",
    "gold_news": "id INT, title STRING NOT NULL, content STRING, source STRING, url STRING, published_at TIMESTAMP, sentiment STRING, keywords STRING, created_at TIMESTAMP",
    "market_factors": f"id INT, type STRING, title STRING NOT NULL, subtitle STRING, description STRING, details ARRAY<STRING>, impact STRING, confidence DOUBLE, {_STAMPS}",
    "institution_views": f"id INT, institution_name STRING NOT NULL, logo STRING, rating STRING, target_price DOUBLE, timeframe STRING, reasoning STRING, key_points ARRAY<STRING>, {_STAMPS}",
    "predictions": "id INT, prediction_type STRING NOT NULL, target_price DOUBLE NOT NULL, confidence DOUBLE, timeframe STRING, reasoning STRING, factors ARRAY<STRING>, created_at TIMESTAMP",
    "update_logs": "id INT, data_type STRING, status STRING, records_affected INT, error_message STRING, duration_seconds DOUBLE, created_at TIMESTAMP",
}


def create_tables(spark: SparkSession, database: str, source: str = "parquet") -> None:
    """Create the database and all tables that it lacks; existing ones stay as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING {source}")


def as_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    """(json): each row as a JSON object, NULL fields included, non-ASCII kept."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return df.select(F.to_json(F.struct("*"), options).alias("json"))


def write_statistics(stats: DataFrame, path: str) -> None:
    """One-row statistics as JSON, in place of the old ones once they are written."""
    replace_json(stats, path, ignoreNullFields="false")


def read_statistics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(current(spark, path))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/tickloom/{name}-{uuid.uuid4().hex}"


def write_partitions(rows: DataFrame, path: str, partition: str, value: Column) -> None:
    """rows as a table partitioned by a column that is a function of each row; partitions that rows don't touch stay as they are."""
    placed = rows.withColumn(partition, value).repartition(partition)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema: str, partition: str) -> DataFrame:
    """The table without its partition column; empty before the first write."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{schema}, {partition} string")
    return spark.read.schema(f"{schema}, {partition} string").parquet(path)


def upsert_partitions(batch: DataFrame, path: str, schema: str, partition: str, value: Column, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
    """Merge a batch into a partitioned table: only partitions that it touches are read, merged and written. Returns their names.

    ``value`` must follow from the key that ``merge(stored, batch)`` goes by. The names of touched partitions go through the driver: as
    many as the batch has. A batch that is applied again changes nothing more, if that holds for merge; the files of other partitions
    are not touched. Spark moves the new files in after the job; a driver lost between removing and moving leaves a touched partition
    without rows, so keep the batches of a table, or use a table format with MERGE, where that must not happen.
    """
    spark = batch.sparkSession
    placed = batch.withColumn("__part", value).where("__part IS NOT NULL")
    touched = sorted(r[0] for r in placed.select(F.col("__part").cast("string")).distinct().collect())
    if touched:
        stored = read_partitions(spark, path, schema, partition).where(F.col(partition).isin(touched)).drop(partition)
        write_partitions(merge(stored, placed.drop("__part")), path, partition, value)
    return touched
