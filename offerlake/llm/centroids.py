"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector carries two numbers from round to round: an upper bound of the distance to
its own centroid and a lower bound of the distance to the second nearest. When the
centroids have moved, the first grows by the drift of the own centroid and the second
shrinks by the largest drift of any other. A vector whose upper bound stays below the
lower one, or below half the distance from its centroid to the next, keeps its centroid;
otherwise the upper bound is replaced by the exact distance and compared once more, and
what is still ambiguous, ties included, is held against all centroids in integers. So the
bounds only save work: assignments are those of exact integer arithmetic.

The table of vectors, assignments and bounds is rewritten once a round in the shared
folder; the driver sees a count and a sum for each centroid and component, nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from offerlake.llm.tables import checkpointed, discard, shared_folder, written

#: Components beyond this, after scaling, are refused: squared distances of up to 64 such components fit a long.
LIMIT = 1 << 27
#: Bounds are widened by this factor, far more than doubles can lose.
SLACK = 1e-9
#: Rows that one step holds against all centroids.
STEP_ROWS = 8192


def quantised(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows `id`, `v`: the vectors that count, each component x as the integer floor(scale * x)."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    sound = vectors.where((F.size(x) == dims) & ~bad).select(
        F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v")
    )
    return sound.where(~F.exists("v", lambda c: F.abs(c) > LIMIT)).select("id", F.col("v").cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose id, written behind the seed, has the smallest SHA-256 as lower-case hex."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in chosen], dtype=np.int64)


def squared(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `v` to a centroid, or to one centroid each."""
    apart = v - centroid
    return np.einsum("ij,ij->i", apart, apart)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of equal ones the first), its squared distance, and that of the second nearest (-1: none)."""
    distances = np.stack([squared(v, c) for c in centroids], axis=1)
    own = distances.argmin(axis=1)
    rows = np.arange(len(v))
    nearest = distances[rows, own]
    if len(centroids) == 1:
        return own, nearest, np.full(len(v), -1)
    distances[rows, own] = np.iinfo(np.int64).max
    return own, nearest, distances.min(axis=1)


def reassign(
    v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, old: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Assignments and bounds for `centroids`, given those for `old`; without `old` every vector is scanned."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    unsure = np.arange(len(v))
    if old is not None:
        drift = np.sqrt(squared(centroids, old).astype(float)) * (1 + SLACK)
        others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(len(drift))])
        between = np.array([[float(squared(centroids[None, i], c)[0]) for c in centroids] for i in range(len(centroids))])
        np.fill_diagonal(between, np.inf)
        half = np.sqrt(between.min(axis=1)) / 2 * (1 - SLACK)
        upper += drift[own]
        lower -= others[own]
        safe = np.maximum(lower, half[own])
        unsure = np.flatnonzero(upper >= safe)
        upper[unsure] = np.sqrt(squared(v[unsure], centroids[own[unsure]])) * (1 + SLACK)
        unsure = unsure[upper[unsure] >= safe[unsure]]
    for start in range(0, len(unsure), STEP_ROWS):
        part = unsure[start : start + STEP_ROWS]
        own[part], nearest, second = scan(v[part], centroids)
        upper[part] = np.sqrt(nearest) * (1 + SLACK)
        lower[part] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0)) * (1 - SLACK))
    return own, upper, lower


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _round(state: DataFrame, centroids: np.ndarray, old: np.ndarray | None, last: bool = False) -> DataFrame:
    """One pass over all vectors; the last gives exact distances instead of vectors and bounds."""
    dims = centroids.shape[1]
    fields = [state.schema["id"], StructField("cluster", IntegerType())]
    if last:
        fields += [StructField("distance", LongType())]
    else:
        fields += [StructField("v", ArrayType(IntegerType())), StructField("upper", DoubleType()), StructField("lower", DoubleType())]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            packed = batch.column("v")
            v = _matrix(packed, dims)
            if old is None:
                own, upper, lower = np.zeros(len(v), np.int64), np.zeros(len(v)), np.zeros(len(v))
            else:
                own = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper, lower = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("upper", "lower"))
            own, upper, lower = reassign(v, own, upper, lower, centroids, old)
            made = {"id": batch.column("id"), "cluster": pa.array(own.astype(np.int32))}
            if last:
                made["distance"] = pa.array(squared(v, centroids[own]))
            else:
                made |= {"v": packed, "upper": pa.array(upper), "lower": pa.array(lower)}
            yield pa.RecordBatch.from_pydict(made)

    return state.mapInArrow(step, StructType(fields))


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; one without vectors stays."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    moved = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row for each centroid
        moved[row.cluster] = [row[f"s{i}"] // row.n for i in range(centroids.shape[1])]
    return moved


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Cluster vectors in exact integer arithmetic.

    Returns one row for each vector that counts: `id_col`, `cluster`, `distance` (squared,
    to its final centroid), `centroid` (its components), `cluster_inertia` and `inertia`
    (distances summed over the cluster and over all). Each round assigns every vector to the
    nearest centroid, of equal ones the first, and moves each centroid to the floor of its
    vectors' mean; after the rounds all are assigned once more.

    Vectors that are null, of another length, or with a null, infinite or undefined component
    don't count, nor do those with a component beyond 2**27 after scaling, whose distances no
    long can hold. Repeated ids and vectors are rows of their own; a null id is kept, and such
    rows become first centroids only if there are no others. With fewer vectors than `k` there
    are as many centroids as vectors; without any the result is empty. Further columns are
    ignored. Equal first centroids leave the later ones empty, and empty ones stay.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, dims, scale, id_col, vector_col)
    centroids, old = first_centroids(rows, k, seed), None
    shape = StructType(
        [StructField("cluster", IntegerType()), StructField("cluster_inertia", LongType()), StructField("inertia", LongType())]
        + [StructField("centroid", ArrayType(LongType()))]
    )
    if not len(centroids):
        nothing = rows.where("false").select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.join(spark.createDataFrame([], shape), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
    place, state = f"{shared_folder(spark)}/centroids-{uuid.uuid4().hex}", rows
    for number in range(rounds):
        state = written(_round(state, centroids, old), f"{place}/{number}")
        if number:
            discard(spark, f"{place}/{number - 1}")
        old, centroids = centroids, _means(state, centroids)
    found = checkpointed(_round(state, centroids, old, last=True))
    discard(spark, place)
    sums = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows at most
    facts = [(j, n, sum(sums.values()), [int(x) for x in centroids[j]]) for j, n in sums.items()]
    return found.join(F.broadcast(spark.createDataFrame(facts, shape)), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
