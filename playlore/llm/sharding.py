"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the table's slots, made from two hashes of
its name. The shards take turns, each claiming the first slot of its permutation
that is still free, until the prime-sized table is full. A key hashes to a slot
and the slot names the shard, so placement is one look-up; when a shard leaves,
nearly all keys of the others stay where they are.

Edge cases: a null key is placed like any other, by the hash of the text "null";
repeated rows share a shard; an empty table stays empty; columns of the input
that clash with an output name are replaced in the output.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.llm.common import read

#: Production parameters: a prime at least a hundred times the number of shards.
N_SHARDS, TABLE_SIZE, SEED = 64, 8191, "shard"


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE, seed: str = SEED) -> list[int]:
    """The table, as an index into shards for each slot. Its size is a parameter, not a function of the data."""
    if size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    if not shards or len(shards) > size:
        raise ValueError("between 1 and `size` shards are needed")
    steps = [(_number(f"{seed}:offset:{s}") % size, _number(f"{seed}:skip:{s}") % (size - 1) + 1) for s in shards]
    table, turn, left = [-1] * size, [0] * len(shards), size
    while left:
        for i, (offset, skip) in enumerate(steps):
            while table[slot := (offset + turn[i] * skip) % size] >= 0:
                turn[i] += 1
            table[slot] = i
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE, seed: str = SEED) -> DataFrame:
    """(slot, shard): `size` rows, built from one literal."""
    filled = F.split(F.lit(",".join(map(str, fill_table(shards, size, seed)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(size).select(
        F.col("id").alias("slot"), F.element_at(names, F.element_at(filled, (F.col("id") + 1).cast("int")).cast("int") + 1).alias("shard")
    )


def slot_of(key: Column, size: int = TABLE_SIZE, seed: str = SEED) -> Column:
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:key:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") % size


def assign(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, seed: str = SEED) -> DataFrame:
    """df with slot and shard. The broadcast side has exactly `size` rows, whatever the data."""
    table = F.broadcast(table_frame(df.sparkSession, shards, size, seed))
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size, seed)).join(table, "slot", "left")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's slot, shard, and shard once one more shard has joined."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    now = assign(docs, "doc_id", shard_names(N_SHARDS))
    grown = F.broadcast(table_frame(spark, shard_names(N_SHARDS + 1)).withColumnRenamed("shard", "shard_grown"))
    return now.join(grown, "slot", "left").select("doc_id", "source", "slot", "shard", "shard_grown")


def _table_sql(name: str, n: int) -> str:
    hexed = lambda what: f"('0x' || substr(md5('{SEED}:{what}:shard-' || lpad(i::VARCHAR, 3, '0')), 1, 13))::BIGINT"
    return f"""
{name}_steps AS (SELECT i, {hexed("offset")} % {TABLE_SIZE} AS o, {hexed("skip")} % {TABLE_SIZE - 1} + 1 AS k FROM range({n}) r(i)),
{name}_fill(turn, tab) AS (
  SELECT 0::BIGINT, list_transform(range({TABLE_SIZE}), lambda x: -1::BIGINT)
  UNION ALL
  SELECT turn + 1, list_transform(tab, lambda v, x: CASE WHEN x = slot + 1 THEN turn % {n} ELSE v END)
  FROM (SELECT turn, tab, (o + k * list_filter(range({TABLE_SIZE}), lambda j: tab[(o + j * k) % {TABLE_SIZE} + 1] = -1)[1]) % {TABLE_SIZE} AS slot
        FROM {name}_fill JOIN {name}_steps ON i = turn % {n} WHERE turn < {TABLE_SIZE})),
{name} AS (SELECT unnest(range({TABLE_SIZE})) AS slot, 'shard-' || lpad(unnest(tab)::VARCHAR, 3, '0') AS shard FROM {name}_fill WHERE turn = {TABLE_SIZE})"""


ORACLE = f"""WITH RECURSIVE {_table_sql("now_t", N_SHARDS)}, {_table_sql("grown_t", N_SHARDS + 1)}
SELECT d.doc_id, d.source, d.slot, a.shard, b.shard AS shard_grown
FROM (SELECT doc_id, source, ('0x' || substr(md5('{SEED}:key:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
JOIN now_t a USING (slot) JOIN grown_t b USING (slot)"""
