"""Banded dynamic time warping: distances, exact and two-stage searches.

Series are arrays of doubles.  Costs are squared differences; a cell further than the
band from the diagonal is out of reach, and series whose lengths differ by more than
the band are infinitely far.  Exact search treats an empty candidate as an error; the
proxy stage and the rerank skip it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import RequestError
from tessera.functions.vectors import col, vector

#: Fixed value: candidates of the proxy stage.
PROXY = 500


def distance(a: np.ndarray, b: np.ndarray, band: int, threshold: float = np.inf) -> float:
    """DTW distance, infinite once a whole row exceeds ``threshold``."""
    n, m = len(a), len(b)
    if not n or not m:
        raise RequestError("empty series")
    if abs(n - m) > band:
        return np.inf
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(1, n + 1):
        lo, hi = max(1, i - band), min(m, i + band)
        cost = (a[i - 1] - b[lo - 1 : hi]) ** 2
        reach = np.minimum(row[lo - 1 : hi], row[lo : hi + 1])
        now = np.full(m + 1, np.inf)
        last = np.inf
        for j, (c, r) in enumerate(zip(cost.tolist(), reach.tolist(), strict=True), lo):
            last = c + (r if r < last else last)
            now[j] = last
        if now[lo : hi + 1].min() > threshold:
            return np.inf
        row = now
    return float(row[m])


def distance_col(a: str | Column, b: str | Column, band: int) -> Column:
    """:func:`distance` inside a plan, for short series (each row is an array fold)."""
    x, y = col(a), col(b)
    inf = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.transform(y, lambda _: inf))

    def advance(state: Column, value: Column) -> Column:
        i = state["i"] + 1
        cells = F.transform(y, lambda v, j: F.when(F.abs(i - (j + 1)) <= band, (value - v) * (value - v)).otherwise(inf))
        steps = F.zip_with(cells, F.sequence(F.lit(0), F.size(y) - 1), lambda c, j: F.struct(c.alias("c"), F.least(F.get(state["row"], j), F.get(state["row"], j + 1)).alias("r")))
        now = F.aggregate(steps, F.array(inf), lambda done, s: F.concat(done, F.array(s["c"] + F.least(s["r"], F.element_at(done, -1)))))
        return F.struct(i.alias("i"), now.alias("row"))

    folded = F.aggregate(x, F.struct(F.lit(0).alias("i"), first.alias("row")), advance, lambda s: F.element_at(s["row"], -1))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.raise_error(F.lit("empty series")).cast("double")).when(F.abs(F.size(x) - F.size(y)) > band, inf).otherwise(folded)


def proxy(a: str | Column, b: str | Column) -> Column:
    """Squared distance of the common prefix and the difference of lengths."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    square = F.zip_with(F.slice(col(a), F.lit(1), n), F.slice(col(b), F.lit(1), n), lambda x, y: (x - y) * (x - y))
    return F.aggregate(square, F.lit(0.0), lambda s, x: s + x) + F.abs(F.size(col(a)) - F.size(col(b)))


def _checked(query: Sequence[float], band: int, max_band: int | None) -> np.ndarray:
    if max_band is not None and band > max_band:
        raise RequestError(f"band {band} is over {max_band}")
    if not len(query):
        raise RequestError("empty query")
    return np.asarray(query, dtype=np.float64)


def _distances(query: np.ndarray, band: int, skip_empty: bool, k: int | None = None):
    """With ``k``, a series is given up once it is further than the k nearest of its partition so far, and is infinitely far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest: list[float] = []  # of the k nearest, the furthest first (negated)
        for batch in batches:
            keys, found = [], []
            for key, series in zip(batch.column("key").to_pylist(), batch.column("series").to_pylist(), strict=True):
                if not series and skip_empty:
                    continue
                keys.append(key)
                far = -nearest[0] if k is not None and len(nearest) == k else np.inf
                found.append(distance(query, np.asarray(series or [], dtype=np.float64), band, far))
                if k is not None and found[-1] < far:
                    (heapq.heappush if len(nearest) < k else heapq.heapreplace)(nearest, -found[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.float64())], names=["key", "distance"])

    return run


def distances_of(query: Sequence[float], band: int, key: str = "series_id", series: str = "series"):
    """A ``mapInArrow`` function from (key, series) rows to (key, distance), infinite ones too."""
    inner = _distances(np.asarray(query, dtype=np.float64), band, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in inner(pa.RecordBatch.from_arrays([b.column(key), b.column(series)], names=["key", "series"]) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=[key, "distance"])

    return run


def _ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    best = scored.orderBy("distance", key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", key))).select("rank", key, "distance")


def _nothing(rows: DataFrame, key: str) -> DataFrame:
    return rows.limit(0).select(F.lit(0).alias("rank"), F.col(key).cast("long").alias(key), F.lit(0.0).alias("distance"))


def topk(rows: DataFrame, query: Sequence[float], k: int, band: int, max_band: int | None = None, key: str = "series_id", series: str = "series", skip_empty: bool = False) -> DataFrame:
    """(rank, key, distance) of the k nearest series within reach; infinite distances are left out."""
    values = _checked(query, band, max_band)
    if k == 0:
        return _nothing(rows, key)
    found = rows.select(F.col(key).cast("long").alias("key"), F.col(series).cast("array<double>").alias("series")).mapInArrow(_distances(values, band, skip_empty, k), "key long, distance double")
    return _ranked(found.filter(F.col("distance") < F.lit(float("inf"))).withColumnRenamed("key", key), k, key)


def proxy_top(rows: DataFrame, query: Sequence[float], n: int = PROXY, key: str = "series_id", series: str = "series") -> DataFrame:
    """(rank, key, distance) of the n nearest non-empty series by :func:`proxy`."""
    _checked(query, 0, None)
    some = rows.filter(F.size(series) > 0).select(key, proxy(series, vector(query)).alias("distance"))
    return _ranked(some, n, key)


def two_stage(rows: DataFrame, query: Sequence[float], k: int, band: int, n: int = PROXY, max_band: int | None = None, key: str = "series_id", series: str = "series") -> DataFrame:
    """Proxy candidates, reranked by DTW."""
    _checked(query, band, max_band)
    chosen = proxy_top(rows, query, n, key, series).select(key)
    return topk(rows.join(F.broadcast(chosen), key, "left_semi"), query, k, band, max_band, key, series, skip_empty=True)  # n ids: bounded
