"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers. Identical quantised vectors are one row with a
multiplicity, so a vector that a third of all rows share is worked on once. Lloyd's
rounds run over those distinct vectors: each task assigns its vectors to the nearest
centroid and sums them in whole numbers, weighted by multiplicity, Spark adds the sums
of the tasks, and k rows reach the driver, which divides them. All numbers are
integers, so the result doesn't depend on how rows are dealt to tasks. At last the
assignments are joined back to the vec_ids by the digest of the vector.

The k centroids are held by the driver and sent to each task: k x dims numbers, whatever the data.

Result: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
Edge cases: vectors that are null, of another length, or that hold a null, NaN or
infinite component are left out; rows with a null vec_id are clustered like others but
start no centroid unless too few rows have an id; rows of one vec_id stay rows, and of
equal hashes the lesser vector starts first; with fewer vectors than centroids there
are fewer centroids; equal centroids leave the later one empty, and it stays as it
is; an empty table gives no rows; other columns are not carried. A component that is
not below WIDEST after scaling is an error, since its squared distances leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.llm.common import forget, read, stash

#: Production parameters: components of a vector, steps in a unit, centroids, rounds, and the seed of their choice.
DIMS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Scaled components lie within this, so that 64 squared differences fit 64 bits.
WIDEST = 1 << 27


def kept(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has `dims` components, all finite."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value, whose order by bytes is that of the row."""
    data = np.ascontiguousarray(rows + (1 << 31), ">u4")
    offsets = np.arange(len(data) + 1, dtype=np.int64) * data.shape[1] * 4
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, ">u4").reshape(-1, dims).astype(np.int64) - (1 << 31)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return _unpacked(b"".join(column.to_pylist()), dims)


def _quantised(dims: int, scale: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            if len(scaled) and np.abs(scaled).max() >= WIDEST:
                raise ValueError(f"a component is not below {WIDEST} after scaling by {scale}")
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(scaled)], names=["vec_id", "vector"])

    return emit


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component, as 32-bit integers in one binary value."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(kept(F.col("embedding"), dims))
    return rows.mapInArrow(_quantised(dims, scale), "vec_id long, vector binary")


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each point, the least of equals, and the squared distance."""
    far = np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(far)), at]


def _summed(centroids: np.ndarray):
    """A task's weighted sums: a row for each cluster that has one of its vectors."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            points, n = _matrix(batch.column(0), centroids.shape[1]), batch.column(1).to_numpy()
            at, _ = _nearest(points, centroids)
            weights = np.where(at == np.arange(len(centroids))[:, None], n, 0)
            counts += weights.sum(axis=1)
            sums += weights @ points
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return emit


def _assigned(centroids: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = _nearest(_matrix(batch.column(0), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(far)], names=["vector", "n", "cluster", "distance"])

    return emit


def starts(rows: DataFrame, k: int = K, seed: int = SEED) -> list[bytes]:
    """The vectors of the k rows whose seeded hash of vec_id is least."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [bytes(r.vector) for r in rows.orderBy(order.asc_nulls_last(), "vector").limit(k).select("vector").collect()]


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds over distinct vectors with their multiplicities n."""
    dims = centroids.shape[1]
    total = [F.sum(F.get("sums", F.lit(i))).alias(f"d{i}") for i in range(dims)]
    for _ in range(rounds):
        sums = distinct.select("vector", "n").mapInArrow(_summed(centroids), "cluster long, n long, sums array<long>")
        moved = centroids.copy()
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # a row for each centroid at most
            moved[r.cluster] = [r[f"d{i}"] // r.n for i in range(dims)]
        centroids = moved
    return centroids


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vectors: vec_id, embedding. A row for each kept row."""
    spark = vectors.sparkSession
    rows = quantised(vectors, dims, scale)
    first = starts(rows, k, seed)
    if not first:
        return spark.createDataFrame([], RESULT)
    distinct = stash(rows.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")
    centroids = lloyd(distinct, _unpacked(b"".join(first), dims), rounds)
    digest = F.unhex(F.sha2("vector", 256)).alias("digest")
    placed = distinct.mapInArrow(_assigned(centroids), "vector binary, n long, cluster int, distance long")
    placed = stash(placed.select(digest, "n", "cluster", "distance"), "placed-vectors")
    forget(distinct)
    spread = {r.cluster: r.spread for r in placed.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("spread")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, s, sum(spread.values()), shas[c]) for c, s in spread.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = rows.select("vec_id", digest).join(placed.drop("n"), "digest")
    return back.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # of: k rows


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _round_sql(i: int) -> str:
    """Assigns to the centroids of round i, then makes those of round i + 1."""
    return f"""a{i} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, list_sum(list_transform(range(1, {DIMS + 1}), lambda j: (k.v[j] - m.v[j]) * (k.v[j] - m.v[j]))) AS d FROM kept k, c{i} m) GROUP BY rid),
u{i} AS (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN kept USING (rid), range(1, {DIMS + 1}) r(j) GROUP BY ALL),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM u{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))"""


ORACLE = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY c LIMIT {K}),
{", ".join(_round_sql(i) for i in range(ROUNDS + 1))},
i AS (SELECT c, sum(d) AS s FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, s::BIGINT AS cluster_inertia, (SELECT sum(d) FROM a{ROUNDS})::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept k USING (rid) JOIN i USING (c) JOIN (SELECT c, v AS w FROM c{ROUNDS}) USING (c)"""
