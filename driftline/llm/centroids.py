"""Centroid clustering on bit planes.

Entries of a vector become whole numbers in two's complement. Bit p of 64
entries is one 64-bit word, so a vector is a few words per plane, and

    x . c = sum over planes p, q of  w_p * w_q * popcount(X_p & C_q)

with w = 1, 2, 4, ... and the last plane's weight negated. Distances follow as
x.x - 2 x.c + c.c, in whole numbers, without rounding.

The planes are packed once and kept as a table. A round reads them, assigns
each vector and adds up its cluster's members inside the task; a task hands on
one row per cluster, so what is shuffled does not grow with the vectors. The
driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.shared import ready, stored
from driftline.llm.vectors import floors, lists_of, sound_vectors

CLUSTERS, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, 1
WORD = 64


def planes_needed(values: np.ndarray) -> int:
    """Planes of two's complement that hold all values, sign included."""
    if not values.size:
        return 1
    return 1 + max(max(int(values.max()), 0).bit_length(), max(int(~values.min()), 0).bit_length())


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """``(rows, planes, words)`` of uint64 from ``(rows, entries)`` of int64; entries are filled up with zeros to whole words."""
    rows, entries = values.shape
    words = -(-entries // WORD)
    padded = np.zeros((rows, words * WORD), dtype=np.int64)
    padded[:, :entries] = values
    out = np.empty((rows, planes, words), dtype=np.uint64)
    for p in range(planes):
        bits = ((padded >> p) & 1).astype(np.uint8)
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return out


def plane_weights(planes: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def unpack(packed: np.ndarray, entries: int) -> np.ndarray:
    """The whole numbers again."""
    rows, planes, words = packed.shape
    out = np.zeros((rows, entries), dtype=np.int64)
    for p, weight in enumerate(plane_weights(planes)):
        octets = np.ascontiguousarray(packed[:, p]).astype("<u8").view(np.uint8).reshape(rows, words * 8)
        out += weight * np.unpackbits(octets, axis=1, bitorder="little")[:, :entries]
    return out


def dots(packed: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot products by weighted popcounts; ``other`` holds one vector's planes, or one per row."""
    total = np.zeros(len(packed), dtype=np.int64)
    ours, theirs = plane_weights(packed.shape[1]), plane_weights(other.shape[-2])
    for p, w in enumerate(ours):
        for r, u in enumerate(theirs):
            common = np.bitwise_count(packed[:, p] & other[..., r, :])
            total += w * u * common.sum(axis=-1, dtype=np.int64)
    return total


@dataclass(frozen=True)
class Centroids:
    """Whole-number centroids with their planes and squares; numbered by their position."""

    values: tuple[tuple[int, ...], ...]

    def __post_init__(self) -> None:
        matrix = np.array(self.values, dtype=np.int64)
        packed = pack(matrix, planes_needed(matrix))
        object.__setattr__(self, "planes", packed)
        object.__setattr__(self, "squares", dots(packed, packed))

    def nearest(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid; the smaller number of equally near ones."""
        best = np.zeros(len(packed), dtype=np.int32)
        least = np.full(len(packed), np.iinfo(np.int64).max)
        for number, planes in enumerate(self.planes):
            away = self.squares[number] - 2 * dots(packed, planes)
            nearer = away < least
            best[nearer], least[nearer] = number, away[nearer]
        return best, least + dots(packed, packed)

    def digest(self, number: int) -> str:
        return hashlib.sha256(",".join(map(str, self.values[number])).encode()).hexdigest()


def packed_batches(batch: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of the vectors of a batch, by their number of planes (each packing task has its own)."""
    lists = batch.column("planes")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)].reshape(len(rows), size // words, words)


def pack_table(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, dims: int = DIMS
) -> DataFrame:
    """``(_id, planes)`` of the vectors with exactly ``dims`` sound entries, kept as a table."""
    ready(table)
    vectors = sound_vectors(table, id_column, vector_column).filter(F.size("_v") == dims)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = floors(batch.column("_v"), scale, dims)
            planes = pack(values, planes_needed(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), lists_of(planes.reshape(len(values), -1).view(np.int64))], ["_id", "planes"]
            )

    schema = T.StructType([vectors.schema["_id"], T.StructField("planes", T.ArrayType(T.LongType()))])
    return stored(vectors.mapInArrow(packed, schema))


def first_centroids(packed: DataFrame, clusters: int, dims: int, seed: int) -> list[tuple[int, ...]]:
    """The vectors with the least hashes of ``seed:id``; of equal ids the one with the least planes first, null ids last."""
    words = -(-dims // WORD)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = packed.withColumn("_h", name).orderBy(F.col("_h").asc_nulls_last(), "planes").limit(clusters)
    return [
        tuple(unpack(np.array(row["planes"], dtype=np.int64).view(np.uint64).reshape(1, -1, words), dims)[0].tolist())
        for row in first.collect()
    ]


def member_sums(packed: DataFrame, centroids: Centroids, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Members and exact entry sums of each cluster that has members."""
    words = -(-dims // WORD)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids.values), dtype=np.int64)
        total = np.zeros((len(count), dims), dtype=np.int64)
        for batch in batches:
            for _, planes in packed_batches(batch, words):
                number, _ = centroids.nearest(planes)
                order = np.argsort(number, kind="stable")
                found, starts = np.unique(number[order], return_index=True)
                total[found] += np.add.reduceat(unpack(planes, dims)[order], starts, axis=0)
                count += np.bincount(number, minlength=len(count))
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(count[found]), lists_of(total[found])], ["cluster", "n", "sums"]
        )

    partial = packed.mapInArrow(add, "cluster int, n long, sums array<long>")
    whole = partial.select("cluster", "n", F.posexplode("sums").alias("entry", "part")).groupBy("cluster", "entry").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    )
    sums: dict[int, tuple[int, list[int]]] = {}
    for row in whole.collect():  # clusters x entries, whatever the number of vectors
        sums.setdefault(row["cluster"], (row["n"], [0] * dims))[1][row["entry"]] = int(row["total"])
    return sums


def moved(centroids: Centroids, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
    """Each centroid at the floor of its members' mean; those without members stay."""
    return Centroids(tuple(
        tuple(x // sums[number][0] for x in sums[number][1]) if number in sums else old
        for number, old in enumerate(centroids.values)
    ))


def cluster(
    table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS,
    id_column: str = "vec_id", vector_column: str = "embedding", seed: int = SEED,
) -> DataFrame:
    """A row per kept vector: its id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``centroid``.

    Kept are vectors of exactly ``dims`` entries, none null or not finite;
    entries count as ``floor(scale * x)``. Rows with a null id are kept like
    any other and never start a cluster unless there are too few others.
    Repeated rows and ids each have their own row. With fewer vectors than
    ``clusters`` there are as many centroids as vectors; an empty table gives
    an empty result. Entries beyond 2**25 after scaling raise, as their squared
    distances might not fit in a long. Other columns are not looked at.
    """
    packed = pack_table(table, id_column, vector_column, scale, dims)
    spark, words = table.sparkSession, -(-dims // WORD)
    start = first_centroids(packed, clusters, dims, seed)
    centroids = Centroids(tuple(start)) if start else None
    for _ in range(rounds if start else 0):
        centroids = moved(centroids, member_sums(packed, centroids, dims))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, planes in packed_batches(batch, words):
                number, distance = centroids.nearest(planes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array(rows)), pa.array(number), pa.array(distance)], ["_id", "cluster", "distance"]
                )

    schema = T.StructType([
        packed.schema["_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
    ])
    assigned = stored(packed.mapInArrow(assign, schema))
    inertia = {row["cluster"]: row["total"] for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = [
        (number, total, sum(inertia.values()), centroids.digest(number), list(centroids.values[number]))
        for number, total in inertia.items()
    ]
    about = spark.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    )
    return assigned.join(F.broadcast(about), "cluster").select(  # one row per cluster
        F.col("_id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
