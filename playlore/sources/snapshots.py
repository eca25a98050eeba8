"""Snapshots of tables: written beside each other, complete only once their manifest is there, and restored only then.

A snapshot is a folder named by its stamp, with a Parquet folder for each table and, written last by a rename, a
manifest: for each table its schema, rows, and the sum of its rows' hashes. A write that breaks off leaves no manifest, so nothing
restores it, and the next snapshot that is completed clears it away. Stamps are texts whose order is that of time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from playlore.functions.scratch import _at, children, delete
from playlore.sources.ingest import restored

MANIFEST = "manifest.json"
#: Complete snapshots that are kept.
KEEP = 14


def _facts(df: DataFrame) -> dict[str, int]:
    """Rows, and the sum of their hashes, which no order and no partitioning changes. Maps are hashed as their entries."""
    cells = [F.to_json(F.struct(c)) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0)).alias("sum")).first()
    return {"rows": n["rows"], "sum": str(n["sum"])}


def _write_last(spark: SparkSession, folder: str, text: str) -> None:
    fs, draft = _at(spark, f"{folder}/_{MANIFEST}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, _at(spark, f"{folder}/{MANIFEST}")[1]):
        raise OSError(f"the manifest of {folder} can't be put in place")


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def complete(spark: SparkSession, root: str) -> list[str]:
    """The stamps of the complete snapshots, in order."""
    return [s for s in children(spark, root) if MANIFEST in children(spark, f"{root}/{s}")]


def snapshot(tables: dict[str, DataFrame], root: str, stamp: str, keep: int = KEEP) -> None:
    """Writes a snapshot and completes it; then clears away all but the last `keep` complete ones and whatever older one is not."""
    spark = next(iter(tables.values())).sparkSession
    if stamp in complete(spark, root):
        raise ValueError(f"there is a complete snapshot {stamp}")
    folder, said = f"{root}/{stamp}", {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        said[name] = {"schema": df.schema.json(), **_facts(spark.read.schema(df.schema).parquet(f"{folder}/{name}"))}
    _write_last(spark, folder, json.dumps({"stamp": stamp, "tables": said}))
    prune(spark, root, keep)


def prune(spark: SparkSession, root: str, keep: int = KEEP) -> list[str]:
    """Deletes the complete snapshots before the last `keep`, and those older than the last complete one that never were; gives their stamps."""
    done = complete(spark, root)
    spare = set(done[: max(0, len(done) - keep)]) | {s for s in children(spark, root) if s not in done and done and s < done[-1]}
    for s in sorted(spare):
        manifest = f"{root}/{s}/{MANIFEST}"
        delete(spark, manifest)  # first, so that a snapshot that is half deleted is not complete
        delete(spark, f"{root}/{s}")
    return sorted(spare)


class Damaged(ValueError):
    """A table of a complete snapshot is not what its manifest says."""


def restore(spark: SparkSession, root: str, current: dict[str, DataFrame] | None = None, stamp: str | None = None, check: bool = True) -> dict[str, DataFrame]:
    """The tables of the last complete snapshot, or of one, in the columns of the current tables where given.

    With check, a table whose rows are not those of its manifest is an error: a snapshot is restored whole or not at all.
    """
    stamps = complete(spark, root)
    if not stamps or (stamp is not None and stamp not in stamps):
        raise ValueError(f"there is no complete snapshot {stamp or ''}".strip())
    folder = f"{root}/{stamp or stamps[-1]}"
    out = {}
    for name, said in json.loads(_read(spark, f"{folder}/{MANIFEST}"))["tables"].items():
        held = spark.read.schema(StructType.fromJson(json.loads(said["schema"]))).parquet(f"{folder}/{name}")
        if check and (found := _facts(held)) != {k: said[k] for k in ("rows", "sum")}:
            raise Damaged(f"{folder}/{name}: {found['rows']} rows, {said['rows']} were written")
        out[name] = restored(current[name], held) if current and name in current else held
    return out
