"""Operator 13: centroid clustering by progressive search over Walsh-Hadamard coefficients.

Vectors are turned into integers and transformed exactly, once; the squared differences of all coefficients add up to
the squared distance times the number of components. Coefficients come by sequency, coarse to fine. After the first
few the centroid that looks nearest is finished, and every other one is given up as soon as its sum so far is strictly
larger than the least finished one; ties are finished. The transform is linear, so sums of members are sums of
coefficients, and a centroid's components come back exactly.

What reaches the driver in a round is one sum per cluster and coefficient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import stored
from millrace.llm.batches import find_package_in_workers
from millrace.llm.registry import query

COMPONENTS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Coefficients looked at first; each further step doubles what has been looked at.
COARSE = 4
#: Coefficients below this have sums of squares that fit 64 bits, as long as there are no more than 64 of them.
SMALL = 1 << 27
VECTORS_AT_A_TIME = 4096


def by_sequency(components: int) -> np.ndarray:
    """The rows of the natural Hadamard matrix by their number of sign changes."""
    rows = np.ones((1, 1), np.int8)
    while len(rows) < components:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def transformed(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of rows of integers, by sequency."""
    count, components = vectors.shape
    found, half = vectors, 1
    while half < components:
        pairs = found.reshape(count, components // (2 * half), 2, half)
        found = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        half *= 2
    return found.reshape(count, components)[:, by_sequency(components)]


def restored(coefficients: np.ndarray) -> np.ndarray:
    """The rows that ``transformed`` made these of."""
    components = coefficients.shape[1]
    natural = np.empty_like(coefficients)
    natural[:, by_sequency(components)] = coefficients
    back = np.argsort(by_sequency(components))
    return transformed(natural)[:, back] // components


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of coefficients the number of the nearest centroid, the smaller one in ties, and its squared distance."""
    if not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(abs(int(found)) for side in (vectors, centroids) for found in (side.min(), side.max())) >= SMALL:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    components = vectors.shape[1]
    seen = min(COARSE, components)
    sums = sum((vectors[:, None, k] - centroids[None, :, k]) ** 2 for k in range(seen))
    guess = sums.argmin(axis=1)
    rest = vectors[:, seen:] - centroids[guess, seen:]
    least = sums[np.arange(len(vectors)), guess] + (rest * rest).sum(axis=1)
    rows, numbers = np.nonzero(sums <= least[:, None])
    totals = sums[rows, numbers]
    while seen < components:
        until = min(2 * seen, components)
        step = vectors[rows, seen:until] - centroids[numbers, seen:until]
        totals = totals + (step * step).sum(axis=1)
        left = totals <= least[rows]
        rows, numbers, totals, seen = rows[left], numbers[left], totals[left], until
    finished = np.full(sums.shape, least.max() + 1, dtype=sums.dtype)
    finished[rows, numbers] = totals
    best = finished.argmin(axis=1)
    return best, finished[np.arange(len(vectors)), best] // components


def usable_vectors(df: DataFrame, vector_column: str, components: int = COMPONENTS) -> DataFrame:
    """The rows whose vector has exactly so many components, all of them finite."""
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(vector_column) == components) & finite)


def vector_coefficients(df: DataFrame, id_column: str, vector_column: str, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """The id and ``coefficients`` (64-bit integers) of each usable vector; components are floor(scale * x)."""
    find_package_in_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scaled = np.floor(flat * scale)
            if len(scaled) and np.abs(scaled).max() * components >= 2.0**62:
                raise ValueError("a component is too large for exact sums of 64 bits")
            found = transformed(scaled.astype(np.int64).reshape(-1, components))
            yield pa.RecordBatch.from_arrays([part.column(0), _packed(found)], [id_column, "coefficients"])

    schema = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, coefficients binary"
    return usable_vectors(df, vector_column, components).select(id_column, vector_column).mapInArrow(run, schema)


def cluster_vectors(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per usable vector: its id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid`` (integers).

    Vectors that are null, of another length or have null or non-finite components are left out. The first centroids
    are the vectors with the smallest digest of seed and id, ties by their coefficients; fewer vectors than
    ``clusters`` make fewer clusters. An empty cluster keeps its centroid. Repeated rows count each. Other columns are
    not looked at, whatever they are called. An empty table gives no rows. ``components`` is a power of two; distances
    and sums that exceed 64 bits are an error.
    """
    vectors = stored(vector_coefficients(df, id_column, vector_column, scale, components))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(digest, "coefficients").limit(clusters).collect()
    schema = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, cluster int, distance bigint"
    schema += ", cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    centroids = np.stack([np.frombuffer(row["coefficients"], "<i8") for row in first])
    for _ in range(rounds):
        totals = _totals(vectors, centroids)
        means = restored(centroids)
        for cluster, row in totals.items():
            # Sums of coefficients go back to sums of components before the division, which is exact.
            means[cluster] = [value // row[components] for value in restored(np.array([row[:components]], object))[0]]
        centroids = transformed(means)
    inertia = {cluster: row[components + 1] for cluster, row in _totals(vectors, centroids).items()}
    whole, final = sum(inertia.values()), restored(centroids).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            best, distance = nearest(_unpacked(part.column(1), components), centroids)
            numbers = best.tolist()
            columns = [
                part.column(0),
                pa.array(best, pa.int32()),
                pa.array(distance.tolist(), pa.int64()),
                pa.array([inertia[k] for k in numbers], pa.int64()),
                pa.array([whole] * len(numbers), pa.int64()),
                pa.array([final[k] for k in numbers], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return vectors.mapInArrow(run, schema)


def _totals(vectors: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """By cluster with members: the sums of its members' coefficients, their number and the sum of their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for part in _parts(batches):
            mine = _unpacked(part.column(1), centroids.shape[1])
            best, distance = nearest(mine, centroids)
            for cluster in np.unique(best).tolist():
                members = best == cluster
                found = [*mine[members].astype(object).sum(axis=0), int(members.sum()), int(distance[members].sum(dtype=object))]
                held[cluster] = [a + b for a, b in zip(held[cluster], found, strict=True)] if cluster in held else found
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["cluster", "totals"])

    parts = vectors.mapInArrow(run, "cluster int, totals array<bigint>").select("cluster", F.posexplode("totals").alias("place", "total"))
    summed = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: dict[int, list[int]] = {}
    for row in summed.orderBy("cluster", "place").collect():
        found.setdefault(row["cluster"], []).append(int(row["total"]))
    return found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS_AT_A_TIME):
            yield batch.slice(at, VECTORS_AT_A_TIME)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows.astype("<i8")], pa.binary())


def _unpacked(column: pa.Array, components: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, components)


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """Every distance computed in full, round after round."""
    square = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""v as materialized (
            select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) e from embeddings
            where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
        "p as materialized (select vec_id, unnest(e) x, unnest(range(len(e))) j from v)",
        f"""c0 as materialized (
            select row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 k, e from v
            order by sha256('{SEED}:' || vec_id) limit {clusters})""",
    ]
    for r in range(rounds):
        steps.append(f"a{r} as materialized (select v.vec_id, arg_min(c.k, {square} * {clusters} + c.k) k from v, c{r} c group by v.vec_id)")
        steps.append(
            f"""m{r} as materialized (
            select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) e
            from (select k, j, cast(sum(x) as bigint) s, count(*) n from a{r} join p using (vec_id) group by k, j) group by k)"""
        )
        steps.append(f"c{r + 1} as materialized (select c.k, coalesce(m.e, c.e) e from c{r} c left join m{r} m using (k))")
    steps.append(
        f"d as materialized (select v.vec_id, c.k, c.e, cast({square} as bigint) distance from v, c{rounds} c "
        f"qualify row_number() over (partition by v.vec_id order by {square}, c.k) = 1)"
    )
    return f"""with {", ".join(steps)}
        select vec_id, cast(k as int) as cluster, distance, cast(sum(distance) over (partition by k) as bigint) as cluster_inertia,
            cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(e, ',')) as centroid_sha256 from d"""


@query("op13_centroid_clustering", _sql())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all usable embeddings, each centroid as a digest."""
    found = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")
