"""Centroid clustering of integer vectors: Lloyd's rounds, sharded by dimensions.

Vectors are cut into blocks of columns and laid out by block, in chunks of up
to ``CHUNK`` vectors that all blocks cut alike. A round works on column blocks:
a task computes, from its block of a chunk and its slice of the centroids, the
exact partial distance of every vector to every centroid. The partial distances
of a chunk are added over its blocks (a reduce by chunk number), the least sum
names each vector's centroid, and the components are summed per block and
centroid. Each block's slice of the centroids is then updated from its own
sums. All numbers are integers, so neither the order of additions nor the
number of tasks shows in the result.

What moves in a round is 4 or 8 bytes per vector, block and centroid, and the
vector once; a chunk is the same amount of work whatever the clusters' sizes, so
a cluster or a vector that holds most rows makes no task larger. Sums are
combined before they are shuffled: centroids x blocks rows per task. The driver
holds the centroids (n_clusters x dimensions integers) and their counts, and no
vectors but the first ``n_clusters``. The cut vectors are written to the shared
folder once; every round reads them, so a lost executor costs its own tasks.

Defined results: a vector is kept if it has exactly ``dimensions`` components,
none null, NaN or infinite; other rows, null vectors among them, have no row in
the result. Each component becomes floor(scale * x). The first centroids are
the kept vectors with the least SHA-256 of ``<seed>:<id>``; a null id comes
last, and rows of one id go by their components. With fewer kept vectors than
``n_clusters`` there are as many centroids as vectors. Repeated rows are
clustered one by one. A centroid without vectors stays where it is. Without any
kept vector, and from an empty table, the result is empty. Components of 2**27
and more in size are an error, as distances would not fit into 64 bits. Columns
other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.columns import shuffles_removed
from tributary.storage import work_folder

CHUNK = 1024
LARGEST = 2**27


@dataclass
class Clusters:
    """What the rounds leave: each vector's centroid and squared distance, and the centroids."""

    assigned: DataFrame  # id, cluster, distance
    centroids: np.ndarray  # int64, one row each


def quantised(vectors: DataFrame, dimensions: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """The id of every vector that is whole and finite, and its components as integers (``__id``, ``__vector``)."""
    vector = vectors[vector_column]
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter((F.size(vector) == dimensions) & ~bad)

    def whole(x: Column) -> Column:
        value = F.floor(x.cast("double") * scale)
        return F.when(F.abs(value) < LARGEST, value).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more in size")).cast("bigint"))

    return kept.select(vectors[id_column].alias("__id"), F.transform(vector, whole).alias("__vector"))


def first_centroids(kept: DataFrame, n_clusters: int, seed: str) -> np.ndarray:
    """The vectors with the least digests of their ids, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "__vector").limit(n_clusters).select("__vector").collect()
    return np.array([row[0] for row in rows], np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """The integers in as few bytes each as hold them all; their number tells which."""
    largest = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"
    return values.astype(kind).tobytes()


def _wide(data: bytes, rows: int, columns: int) -> np.ndarray:
    kind = f"<i{len(data) // (rows * columns)}"
    return np.frombuffer(data, kind).reshape(rows, columns).astype(np.int64)


def _cut(kept: DataFrame, dimensions: int, block_size: int, chunk: int) -> DataFrame:
    """The vectors by column block (``block``, a partition column) and chunk; block 0 holds the ids of its chunk too."""
    kind = kept.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            for begin in range(0, len(flat), chunk):
                part, ids = flat[begin : begin + chunk], batch.column(0).slice(begin, chunk)
                blocks = range(0, dimensions, block_size)
                held = pa.ListArray.from_arrays(pa.array([0] + [len(part)] * len(blocks), pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(blocks), pa.int64()),
                        pa.array([len(part)] * len(blocks), pa.int32()),
                        pa.array([_narrow(part[:, b : b + block_size]) for b in blocks], pa.binary()),
                        held,
                        pa.array(range(len(blocks)), pa.int32()),
                    ],
                    names=["chunk", "n", "components", "ids", "block"],
                )
                number += 1

    cut = kept.mapInArrow(run, f"chunk bigint, n int, components binary, ids array<{kind}>, block int")
    spark, path = kept.sparkSession, work_folder(kept.sparkSession, "column-blocks")
    cut.write.partitionBy("block").parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def partial_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids over some columns, exact."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * float(largest) ** 2 * max(vectors.shape[1], 1) < 2**52:  # doubles are exact for these
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    total = np.zeros((len(vectors), len(centroids)), np.int64)
    for column in range(vectors.shape[1]):
        total += (vectors[:, column, None] - centroids[None, :, column]) ** 2
    return total


def _partials(cut: DataFrame, slices: list[np.ndarray], with_ids: bool) -> DataFrame:
    """Each row of the cut table with its partial distances: chunk, block, n, components (and ids), distances."""
    names = ["chunk", "block", "n", "components", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one chunk: a thousand vectors
                row = batch.slice(i, 1)
                block, n, data = (row.column(k)[0].as_py() for k in (1, 2, 3))
                near = slices[block]
                found = _narrow(partial_distances(_wide(data, n, near.shape[1]), near))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([found], pa.binary())], names=[*names, "distances"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(names).schema)
    return cut.select(names).mapInArrow(run, f"{schema}, distances binary")


def _added(group: pa.Table, n_clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector of a chunk and its distance; of equals the smallest number."""
    n = group.column("n")[0].as_py()
    total = np.zeros((n, n_clusters), np.int64)
    for data in group.column("distances").to_pylist():
        total += _wide(data, n, n_clusters)
    nearest = total.argmin(axis=1)
    return nearest, total[np.arange(n), nearest]


def _updated(cut: DataFrame, centroids: np.ndarray, block_size: int) -> np.ndarray:
    """The centroids after one round."""
    k, dimensions = centroids.shape
    slices = [centroids[:, b : b + block_size] for b in range(0, dimensions, block_size)]

    def sums(group: pa.Table) -> pa.Table:
        nearest, _ = _added(group, k)
        which, back = np.unique(nearest, return_inverse=True)
        out = []
        for block, n, data in zip(*(group.column(name).to_pylist() for name in ("block", "n", "components")), strict=True):
            part = np.zeros((len(which), block_size), np.int64)
            width = slices[block].shape[1]
            np.add.at(part[:, :width], back, _wide(data, n, width))
            out.append(np.column_stack([np.full(len(which), block), which, np.bincount(back), part]))
        rows = np.concatenate(out)
        return pa.Table.from_arrays([pa.array(column) for column in rows.T], names=names)

    names = ["block", "cluster", "n", *(f"s{j}" for j in range(block_size))]
    parts = _partials(cut, slices, False).groupBy("chunk").applyInArrow(sums, ", ".join(f"{name} bigint" for name in names))
    total = parts.groupBy("block", "cluster").agg(*[F.sum(name).alias(name) for name in names[2:]])
    # Exact floors of sum / n: the remainder is taken away first.
    moved = total.select("block", "cluster", *[F.expr(f"(s{j} - pmod(s{j}, n)) div n").alias(f"s{j}") for j in range(block_size)])
    after = centroids.copy()
    for row in moved.collect():  # blocks x centroids rows at most
        begin = row["block"] * block_size
        width = min(block_size, dimensions - begin)
        after[row["cluster"], begin : begin + width] = row[2 : 2 + width]
    return after


def _assigned(cut: DataFrame, centroids: np.ndarray, block_size: int, id_column: str) -> DataFrame:
    slices = [centroids[:, b : b + block_size] for b in range(0, centroids.shape[1], block_size)]
    kind = cut.schema["ids"].dataType.elementType.simpleString()

    def rows(group: pa.Table) -> pa.Table:
        nearest, distance = _added(group, len(centroids))
        first = group.column("block").to_pylist().index(0)
        ids = group.column("ids").slice(first, 1).combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(distance)], names=["__id", "cluster", "distance"])

    found = _partials(cut, slices, True).groupBy("chunk").applyInArrow(rows, f"__id {kind}, cluster int, distance bigint")
    spark, path = cut.sparkSession, work_folder(cut.sparkSession, "assigned")
    found.withColumnRenamed("__id", id_column).write.parquet(path)
    return spark.read.parquet(path)


def lloyd(
    vectors: DataFrame,
    n_clusters: int,
    rounds: int,
    dimensions: int,
    scale: int = 256,
    seed: str = "2",
    block_size: int = 32,
    chunk: int = CHUNK,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> Clusters:
    """Cluster all whole vectors; ``rounds`` updates, then each vector is assigned once more."""
    spark: SparkSession = vectors.sparkSession
    kept = quantised(vectors, dimensions, scale, id_column, vector_column)
    centroids = first_centroids(kept, n_clusters, seed)
    if not len(centroids):
        kind = vectors.schema[id_column].dataType.simpleString()
        return Clusters(spark.createDataFrame([], f"`{id_column}` {kind}, cluster int, distance bigint"), np.zeros((0, dimensions), np.int64))
    with shuffles_removed(spark):
        cut = _cut(kept, dimensions, block_size, chunk)
        for _ in range(rounds):
            centroids = _updated(cut, centroids, block_size)
        return Clusters(_assigned(cut, centroids, block_size, id_column), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """Each vector's row with the distances summed over its cluster and over all, and its centroid's digest."""
    spark = found.assigned.sparkSession
    sums = {row["cluster"]: row["sum"] for row in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    whole = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest() for centroid in found.centroids]
    rows = [(cluster, total, whole, digests[cluster]) for cluster, total in sorted(sums.items())]
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.assigned.join(F.broadcast(figures), "cluster")  # a row per centroid
