"""Centroid clustering whose nearest-centroid search is progressive over Walsh-Hadamard coefficients.

Vectors are whole numbers. The Walsh-Hadamard transform of 64 components adds and subtracts only, so
it is exact, and squared distances between transforms are 64 times those between vectors. The search
adds up squared coefficient differences from coarse coefficients (few sign changes) to fine ones. A
partial sum never exceeds the whole one, so a centroid whose partial sum is above the whole distance
of another centroid is strictly worse and goes; the rest are followed through all 64 coefficients.

A round is one pass over the stored vectors. Each task adds up its vectors by cluster before anything
is shuffled, so a cluster with most of the vectors is one row a task. The driver holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, ship, stored

SIZE = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Coefficients seen after each step of the search.
STEPS = (4, 16, 32, SIZE)
ROWS = 2048
#: Up to this magnitude 64-bit numbers hold every intermediate value; beyond it Python's own are used.
SAFE = 1 << 24
LONGEST = (1 << 63) - 1

Centres = list[list[int]]


def _by_sign_changes(size: int) -> np.ndarray:
    signs = np.array([[(-1) ** (i & j).bit_count() for j in range(size)] for i in range(size)])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1))


COARSE_FIRST = _by_sign_changes(SIZE)


def walsh(vectors: np.ndarray) -> np.ndarray:
    """Exact Walsh-Hadamard transform of whole-number rows, coefficients by number of sign changes."""
    rows, size = vectors.shape
    half = 1
    while half < size:
        pairs = vectors.reshape(rows, size // (2 * half), 2, half)
        vectors = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        half *= 2
    return vectors.reshape(rows, size)[:, COARSE_FIRST]


def _squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


def nearest(coefficients: np.ndarray, centres: np.ndarray, steps: Sequence[int] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance, by transforms; ties take the smaller number."""
    seen = steps[0]
    coarse = _squares(coefficients[:, None, :seen] - centres[None, :, :seen])
    bound = _squares(coefficients - centres[coarse.argmin(axis=1)])
    row, centre = np.nonzero(coarse <= bound[:, None])
    total = coarse[row, centre]
    for upto in steps[1:]:
        total = total + _squares(coefficients[row, seen:upto] - centres[centre, seen:upto])
        left = total <= bound[row]
        row, centre, total = row[left], centre[left], total[left]
        seen = upto
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, starts)
    first = np.unique(row[hit := total == least[row]], return_index=True)[1]
    return centre[hit][first], least // SIZE


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, in the narrowest exact form."""
    if not values.size or np.abs(values).max() <= SAFE:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], dtype=object)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            values = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            yield piece.column(0), values


def whole_vectors(df: DataFrame, column: str, key: str, scale: int = SCALE) -> DataFrame:
    """(key, parts) of the vectors with 64 finite components: floor(scale * x), as doubles.

    Every such floor is a double. A component whose product with ``scale`` overflows a double counts
    as non-finite.
    """
    scaled = F.transform(F.col(column), lambda x: x.cast("double") * scale)
    finite = F.forall("parts", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    fit = df.where(F.size(column) == SIZE).select(key, scaled.alias("parts")).where(finite)
    schema = pa.schema([("parts", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in _pieces(batches):
            offsets = pa.array(np.arange(0, values.size + 1, SIZE), pa.int32())
            parts = pa.ListArray.from_arrays(offsets, pa.array(np.floor(values).ravel()))
            yield pa.RecordBatch.from_arrays([keys, parts], schema=schema.insert(0, pa.field(key, keys.type)))

    kind = fit.schema[key].dataType.simpleString()
    return arrow_map(fit, run, f"`{key}` {kind}, parts array<double>")


def first_centres(vectors: DataFrame, key: str, clusters: int, seed: int) -> Centres:
    """The vectors with the smallest SHA-256 of ``seed:key``; equal keys in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "parts").orderBy("digest", "parts").limit(clusters).collect()
    return [[int(x) for x in row.parts] for row in rows]


def _prepared(centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """The transforms of the centres as 64-bit numbers (if they are safe) and as Python's."""
    exact = walsh(np.array(centres, dtype=object))
    safe = max(abs(x) for c in centres for x in c) <= SAFE
    return (exact.astype(np.int64) if safe else exact), exact


def _search(values: np.ndarray, prepared: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = whole(values)
    if vectors.dtype == object or prepared[0].dtype == object:
        vectors = vectors.astype(object)
        return vectors, *nearest(walsh(vectors), prepared[1])
    return vectors, *nearest(walsh(vectors), prepared[0])


def moved(vectors: DataFrame, centres: Centres) -> Centres:
    """Every centre replaced by the floor of the mean of the vectors nearest to it; empty ones stay."""
    prepared = _prepared(centres)
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))])
    text = "cluster int, n long, total array<string>"

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(centres), np.int64), np.zeros((len(centres), SIZE), dtype=object)
        for _, values in _pieces(batches):
            parts, cluster, _ = _search(values, prepared)
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            totals[cluster[order][starts]] += np.add.reduceat(parts[order], starts).astype(object)
            counts += np.bincount(cluster, minlength=len(centres))
        hit = np.flatnonzero(counts)
        yield batch_of(schema, cluster=hit, n=counts[hit], total=[[str(x) for x in totals[c]] for c in hit])

    def across(part: pa.Table) -> pa.Table:
        total = [sum(map(int, column)) for column in zip(*part.column("total").to_pylist())]
        n = sum(part.column("n").to_pylist())
        return pa.Table.from_batches([batch_of(schema, cluster=part.column("cluster")[:1].combine_chunks(), n=[n], total=[[str(x) for x in total]])])

    sums = arrow_map(vectors, within, text).groupBy("cluster").applyInArrow(across, text)
    new = list(centres)
    for row in sums.collect():
        new[row.cluster] = [int(x) // row.n for x in row.total]
    return new


def assigned(vectors: DataFrame, key: str, centres: Centres) -> DataFrame:
    """(key, cluster, distance): the nearest centre; a squared distance beyond a long is NULL."""
    prepared = _prepared(centres)
    schema = pa.schema([("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in _pieces(batches):
            _, cluster, distance = _search(values, prepared)
            if distance.dtype == object:
                distance = [int(d) if d <= LONGEST else None for d in distance]
            yield batch_of(schema.insert(0, pa.field(key, keys.type)), **{key: keys, "cluster": cluster, "distance": distance})

    kind = vectors.schema[key].dataType.simpleString()
    return arrow_map(vectors, run, f"`{key}` {kind}, cluster int, distance long")


def clustered(
    embeddings: DataFrame,
    column: str = "embedding",
    key: str = "vec_id",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
) -> DataFrame:
    """Cluster, squared distance and inertia of every vector with 64 finite components.

    Vectors that are NULL, of another length, or hold a NULL, NaN or infinite component are not
    returned. NULL keys hash as the empty text and are returned; repeated rows count and come back
    repeated. With fewer vectors than ``clusters`` every vector starts a centroid; an empty table gives
    an empty result. Components of any finite size are handled exactly; a distance or inertia beyond a
    long is NULL. Equal distances take the smaller centroid number. Other columns are not read.
    """
    ship(embeddings.sparkSession)
    spark = embeddings.sparkSession
    vectors = stored(whole_vectors(embeddings, column, key, scale))
    centres = first_centres(vectors, key, clusters, seed)
    if not centres:
        return vectors.selectExpr(
            f"`{key}`", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256"
        )
    for _ in range(rounds):
        centres = moved(vectors, centres)
    found = stored(assigned(vectors, key, centres))
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("lost")
    ).collect()
    inertia = {r.cluster: None if r.lost else int(r.total) for r in sums}
    fits = lambda x: x if x is not None and x <= LONGEST else None
    whole_sum = None if None in inertia.values() else sum(inertia.values())
    named = spark.createDataFrame(
        [
            (c, fits(total), fits(whole_sum), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
            for c, total in inertia.items()
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(named), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
