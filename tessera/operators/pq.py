"""Product quantisation: training, codes, asymmetric distances and the two-stage archive search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import RequestError
from tessera.functions import vectors as V
from tessera.functions.scalars import choose_subspaces
from tessera.operators.search import top

#: Centroids of a subspace, training turns, tolerance and seed of archives; fewer rows stay raw.
CENTROIDS, TURNS, TOLERANCE, SEED, LEAST_ROWS = 256, 15, 1e-4, 42, 256
#: Rows that a codebook is trained on at most: a uniform sample by hash of the id.
SAMPLE = 100_000


def quantised(rows: int, level: int, dim: int) -> bool:
    """Whether a segment of a level is stored as codes."""
    return level >= 2 and rows >= LEAST_ROWS and choose_subspaces(dim) > 1


def plus_plus(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Initial centroids, each drawn with probability in proportion to its squared distance from those before."""
    chosen = [int(rng.integers(len(points)))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = np.cumsum(far)
        chosen.append(int(rng.integers(len(points))) if total[-1] <= 0 else int(min(np.searchsorted(total, rng.random() * total[-1], side="right"), len(points) - 1)))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen].copy()


def lloyd(points: np.ndarray, k: int, turns: int = TURNS, tolerance: float = TOLERANCE, seed: int = SEED) -> np.ndarray:
    """Centroids after at most ``turns`` rounds; ties go to the lowest, an empty one is drawn anew."""
    if len(points) < k:
        raise RequestError(f"{len(points)} points for {k} centroids")
    rng = np.random.default_rng(seed)
    centroids = plus_plus(points, k, rng)
    for _ in range(turns):
        near = ((points * points).sum(1)[:, None] - 2 * points @ centroids.T + (centroids * centroids).sum(1)).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        after = np.stack([np.bincount(near, weights=points[:, d], minlength=k) for d in range(points.shape[1])], axis=1) / np.maximum(count, 1)[:, None]
        for dead in np.flatnonzero(count == 0):
            after[dead] = points[rng.integers(len(points))]
        moved = ((after - centroids) ** 2).sum(axis=1).max()
        centroids = after
        if moved < tolerance**2:
            break
    return centroids


def train(rows: DataFrame, dim: int, parts: int = 0, k: int = CENTROIDS, seed: int = SEED, vector: str = "vector", key: str = "vector_id", sample: int = SAMPLE) -> DataFrame:
    """(subspace, centroids): a codebook of each subspace, trained in a task of its own on at most ``sample`` rows."""
    parts = parts or choose_subspaces(dim)
    if dim % parts:
        raise RequestError(f"{parts} subspaces do not divide {dim}")
    size = dim // parts
    chosen = rows.select(key, vector).orderBy(F.xxhash64(key), key).limit(sample)
    if chosen.count() < k:
        raise RequestError(f"fewer than {k} rows to train on")
    pieces = chosen.select(key, F.posexplode(V.subvectors(vector, parts, size)).alias("subspace", "piece"))

    def fit(frame):
        frame = frame.sort_values(key)
        points = np.array([*frame["piece"]], dtype=np.float64)
        subspace = int(frame["subspace"].iloc[0])
        return frame.iloc[:1].assign(subspace=subspace, centroids=[lloyd(points, k, seed=seed + subspace).tolist()])[["subspace", "centroids"]]

    return pieces.groupBy("subspace").applyInPandas(fit, "subspace int, centroids array<array<double>>")


def book_of(codebook: DataFrame) -> list[list[list[float]]]:
    """The codebook as nested lists: dim * 256 numbers, however many rows there are."""
    return [r["centroids"] for r in codebook.orderBy("subspace").collect()]


def book_frame(spark: SparkSession, book: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """A one-row frame (book) to broadcast to the rows that are encoded or decoded."""
    return spark.createDataFrame([([[[float(x) for x in c] for c in s] for s in book],)], "book array<array<array<double>>>")


def encode(vector: str | Column, book: str | Column, parts: int, size: int) -> Column:
    """Codes: the nearest centroid of each subspace."""
    return F.zip_with(V.subvectors(vector, parts, size), V.col(book), lambda piece, centroids: V.nearest(piece, centroids))


def encoder(book: Sequence[Sequence[Sequence[float]]]):
    """:func:`encode` on Arrow batches, for codebooks of the usual 256 centroids: the same sums in the same order, and ties alike."""
    centroids = np.asarray(book, dtype=np.float64)
    parts, _, size = centroids.shape

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(vectors: pd.Series) -> pd.Series:
        out = np.zeros((len(vectors), parts), dtype=np.int32)
        for at in range(0, len(vectors), 512):
            table = np.array([*vectors.iloc[at : at + 512]], dtype=np.float64).reshape(-1, parts, size)
            for s in range(parts):
                far = np.zeros((len(table), centroids.shape[1]))
                for d in range(size):
                    step = table[:, s, d, None] - centroids[s, None, :, d]
                    far += step * step
                out[at : at + 512, s] = far.argmin(axis=1)
        return pd.Series(list(out))

    return run


def decode(codes: str | Column, book: str | Column) -> Column:
    return F.flatten(F.zip_with(V.col(codes), V.col(book), lambda c, centroids: F.get(centroids, c)))


def adc_table(book: Sequence[Sequence[Sequence[float]]], query: Sequence[float]) -> list[list[float]]:
    """Squared distance of each centroid from the query's part."""
    out, at = [], 0
    for centroids in book:
        size = len(centroids[0])
        part = [float(x) for x in query[at : at + size]]
        out.append([_square(part, c) for c in centroids])
        at += size
    return out


def _square(a: Sequence[float], b: Sequence[float]) -> float:
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return total


def adc(codes: str | Column, table: str | Column) -> Column:
    """Asymmetric distance: the sum of a row's table entries."""
    return F.aggregate(F.zip_with(V.col(codes), V.col(table), lambda c, t: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)


def nearest_codes(rows: DataFrame, book: Sequence[Sequence[Sequence[float]]], query: Sequence[float], k: int, key: str = "vector_id", codes: str = "codes") -> DataFrame:
    """The 4k ``rows`` nearest to ``query`` by asymmetric distance, ties to the smaller id."""
    table = rows.sparkSession.createDataFrame([(adc_table(book, query),)], "_adc array<array<double>>")  # one row
    return rows.join(F.broadcast(table)).withColumn("_far", adc(codes, "_adc")).orderBy("_far", key).limit(max(4 * k, k)).drop("_adc", "_far")


def decoded(rows: DataFrame, book: Sequence[Sequence[Sequence[float]]], codes: str = "codes") -> DataFrame:
    """``rows`` with the vector that their codes stand for."""
    return rows.join(F.broadcast(book_frame(rows.sparkSession, book))).withColumn("vector", decode(codes, "book").cast("array<float>")).drop("book")


def archive_search(rows: DataFrame, book: Sequence[Sequence[Sequence[float]]], query: Sequence[float], k: int, key: str = "vector_id", codes: str = "codes") -> DataFrame:
    """(rank, key, score) of one archive segment: 4k rows by asymmetric distance, reranked by the inner product with the decoded vector."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(adc_table(book, query),)], "adc array<array<double>>")
    near = rows.join(F.broadcast(table)).select(key, codes, adc(codes, "adc").alias("far")).orderBy("far", key).limit(max(4 * k, k))
    scored = near.join(F.broadcast(book_frame(spark, book))).select(key, V.dot(decode(codes, "book"), V.vector(query)).alias("score"))
    return top(scored, k, key).select("rank", key, "score")


def kmeans_step(points: DataFrame, centroids: Sequence[Sequence[float]], vector: str = "vector") -> DataFrame:
    """(cluster, members, mean sums per dimension): one assignment and update turn, grouped with map-side sums."""
    dim = len(centroids[0])
    books = F.array(*(V.vector(c) for c in centroids))
    assigned = points.select(V.nearest(vector, books).alias("cluster"), F.col(vector).alias("v"))
    return assigned.groupBy("cluster").agg(F.count("*").alias("members"), *(F.avg(F.get("v", F.lit(d)).cast("double")).alias(f"c{d}") for d in range(dim)))
