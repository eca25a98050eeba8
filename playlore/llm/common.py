"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of ASCII only, as the word definitions of this package use it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, by spark.checkpoint.dir. Only a local session, as in tests, may leave it unset."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    It cuts lineage, survives the loss of any executor, and, unlike a cached
    plan, is planned anew: joins on it get exchanges that adaptive execution
    can split when a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what stash wrote for df. For intermediate results that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def marked(rows: DataFrame, keys: DataFrame, name: str = "doc_id") -> DataFrame:
    """rows with maybe: false if the key `name` is surely not among keys. For keeping most rows out of a shuffle.

    It is a bitmap of hashed keys, 2 ** 26 bits or 8 MB for any number of rows, broadcast; where it fills up, more rows are marked.
    """
    spot = lambda df: df.withColumn("spot", F.pmod(F.xxhash64(name), F.lit(1 << 26)))
    bits = spot(keys).groupBy(F.expr("spot div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("spot % 32768")).alias("bits"))
    met = spot(rows).withColumn("bucket", F.expr("spot div 32768")).join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("spot") % 32768 / 8 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("spot") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_interval(key: Column, seed: str) -> Column:
    """A hash of key as a double in [0, 1), from 52 bits of MD5, alike in any engine."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(4503599627370496.0)


def row_key(doc_id: Column, text: Column) -> Column:
    """A text that names a row by id and content, null id or not; rows with the same id and text share it."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))
