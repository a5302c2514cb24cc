"""Historical bars and news from raw payloads.

Each reader takes a DataFrame with one payload per row and yields rows; malformed rows are left out, never raised.
"""

from __future__ import annotations

import codecs
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import safe_double

BAR_SCHEMA = "date date, open_price double, high_price double, low_price double, close_price double, volume int"


def bars_from_jsonp(payloads: DataFrame, start: str, column: str = "payload") -> DataFrame:
    """``var X = [[date, open, high, low, close, volume], ...];`` from a day on."""
    body = F.regexp_extract(column, r"(?s)=\s*(\[.*\])", 1)
    row = F.explode(F.from_json(body, "array<array<string>>")).alias("r")
    r = payloads.select(row)
    num = lambda i: safe_double(F.get("r", i))
    out = r.select(F.try_to_date(F.get("r", F.lit(0)), "yyyy-MM-dd").alias("date"), num(F.lit(1)).alias("open_price"), num(F.lit(2)).alias("high_price"), num(F.lit(3)).alias("low_price"), num(F.lit(4)).alias("close_price"), num(F.lit(5)).cast("int").alias("volume"))
    return out.where(F.col("date") >= F.lit(start).cast("date"))


def bars_from_klines(payloads: DataFrame, start: str, column: str = "payload") -> DataFrame:
    """JSON ``data.klines`` of "date,open,close,low,high,volume" lines; high and low are swapped where they are crossed."""
    line = F.explode(F.from_json(column, "data struct<klines:array<string>>")["data"]["klines"]).alias("line")
    f = payloads.select(line).select(F.split("line", ",").alias("f")).where(F.size("f") >= 6)
    num = lambda i: safe_double(F.get("f", F.lit(i)))
    out = f.select(F.try_to_date(F.get("f", F.lit(0)), "yyyy-MM-dd").alias("date"), num(1).alias("open_price"), F.greatest(num(3), num(4)).alias("high_price"), F.least(num(3), num(4)).alias("low_price"), num(2).alias("close_price"), num(5).cast("int").alias("volume"))
    return out.where(F.col("date") >= F.lit(start).cast("date"))


def bars_from_frame(frame: DataFrame, digits: int = 2) -> DataFrame:
    """Columns Date, Open, High, Low, Close, Volume, rounded; a missing volume is 0."""
    price = lambda c: F.round(c, digits)
    return frame.select(F.to_date("Date").alias("date"), price("Open").alias("open_price"), price("High").alias("high_price"), price("Low").alias("low_price"), price("Close").alias("close_price"), F.coalesce(F.nanvl(F.col("Volume").cast("double"), F.lit(0.0)), F.lit(0.0)).cast("int").alias("volume"))


def without_volume(bars: DataFrame, digits: int = 4) -> DataFrame:
    """The bars of an index, which has no volume, with rounded prices."""
    return bars.select("date", *(F.round(c, digits).alias(c) for c in ("open_price", "high_price", "low_price", "close_price")))


def first_source(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any; an error if none has. Sources behind that one are not run."""
    for rows in sources:
        if not rows.isEmpty():
            return rows
    raise ValueError("all sources are empty")


def read_rss(spark: SparkSession, path: str, source: str, limit: int = 10) -> DataFrame:
    """The first items of an RSS file: title, content, url, source, published."""
    schema = "title string, description string, link string, pubDate string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select("title", F.col("description").alias("content"), F.col("link").alias("url"), F.lit(source).alias("source"), F.col("pubDate").alias("published")).limit(limit)


def read_feeds(spark: SparkSession, feeds: dict[str, str], limit: int = 10) -> tuple[list[DataFrame], dict[str, str]]:
    """(frames, failures): the feeds that can be read, source to path, and the errors of those that cannot.

    A feed is read to its last row here, ``limit`` rows at most, so one that breaks late fails here too and leaves the others as
    they are.
    """
    frames, failures = [], {}
    for source, path in feeds.items():
        try:
            rows = read_rss(spark, path, source, limit)
            frames.append(spark.createDataFrame(rows.collect(), rows.schema))
        except Exception as error:  # whatever a source does wrong
            failures[source] = str(error).split("\n")[0]
    return frames, failures


def union_feeds(feeds: list[DataFrame], per_source: int = 5, summary: int | None = None) -> DataFrame:
    """All feeds, so many rows of each; ``summary`` cuts the content to that many characters."""
    rows = reduce(lambda a, b: a.unionByName(b), feeds)
    line = Window.partitionBy("source").orderBy(F.desc("published"), "title")
    rows = rows.withColumn("_rn", F.row_number().over(line)).where(F.col("_rn") <= per_source).drop("_rn")
    return rows if summary is None else rows.withColumn("content", F.substring("content", 1, summary))


def decoded(df: DataFrame, column: str, charset: str = "gb2312") -> DataFrame:
    """df with a binary column as text. Bytes that the charset doesn't know become U+FFFD, one for each as Python's codec counts
    them; NULL stays NULL. Spark's own decoding takes Unicode charsets only, so the bytes pass through Arrow batches."""
    codecs.lookup(charset)
    names, place = df.columns, df.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == column else f.dataType, True) for f in df.schema.fields])

    def run(batches):
        for batch in batches:
            text = [None if b is None else b.decode(charset, "replace") for b in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns)], names)

    return df.mapInArrow(run, schema)


def read_bytes(spark: SparkSession, path: str, charset: str = "gb2312") -> DataFrame:
    """(path, payload): the text of each raw file, as a source sent it. A file is one row; an empty one has none."""
    files = spark.read.format("binaryFile").load(path)
    return decoded(files.select("path", F.col("content").alias("payload")), "payload", charset)


def read_jdbc(spark: SparkSession, url: str, name: str, partition_column: str | None = None, bounds: tuple[str, str] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table, read in ranges of a column where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize="10000", **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(partitions))
    return reader.load()


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cached document with its envelope: data, _timestamp (epoch seconds), _created_at."""
    return spark.read.schema(f"data {schema}, _timestamp double, _created_at string").json(current(spark, path), multiLine=True)


def write_cache(data: DataFrame, path: str, now: float, created_at: str) -> None:
    """One-row data as a cached document, in place of the old one once it is written."""
    row = data.select(F.struct("*").alias("data"), F.lit(now).alias("_timestamp"), F.lit(created_at).alias("_created_at"))
    replace_json(row, path)


def _versions(spark: SparkSession, path: str):
    """(file system, folder, numbers of complete versions ascending, all numbers)."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    numbers = sorted(int(n.removeprefix("version=")) for n in found if n.startswith("version=") and n.removeprefix("version=").isdigit())
    done = [n for n in numbers if files.exists(context._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS"))]
    return files, folder, done, numbers


def current(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete version of what ``replace_json`` wrote; the path itself where there are no versions."""
    done = _versions(spark, path)[2]
    return f"{path}/version={done[-1]}" if done else path


def replace_json(rows: DataFrame, path: str, keep: int = 2, **options: str) -> None:
    """rows as one JSON file, the new version of the document at ``path``; ``current`` finds it.

    A version is a folder of its own that counts once Spark has marked it as complete, so there is a document at every moment: a
    write that fails leaves the old one, and a reader that has started keeps the version that it found. The last ``keep`` versions
    stay. One writer at a time.
    """
    spark = rows.sparkSession
    files, _, _, numbers = _versions(spark, path)
    rows.coalesce(1).write.options(**options).json(f"{path}/version={numbers[-1] + 1 if numbers else 1}")
    *_, done, numbers = _versions(spark, path)
    for n in numbers:
        if n < done[-1] and n not in done[-keep:]:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}"), True)
