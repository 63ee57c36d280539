"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A term is a vector component, its posting list the candidates with a weight there.
Query rows are sparse (component, weight) lists.  For a block of candidates, each
query scatters its weights' multiples of the postings into a dense score array, term
by term; the k best of the array are selected, and the blocks' selections merged.

Queries and candidates are dealt into blocks of bounded bytes, and every query block
meets every candidate block in a task of its own: the stated query set against all
rows, with no limit on either.  A side travels once for each block of the other, so
blocks are as large as a task's memory lets them be.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import partitions_for

#: Bytes of a block's vectors, 8 a component; and rows that a block has at least, where smaller ones would keep more cores busy.
BLOCK = 8 << 20
LEAST_ROWS = 1024
_FIT = float(1 << 62)


def _floor(x: Column) -> Column:
    """floor(x) as a double: one of 2**53 or more is an integer already, and may not fit Spark's."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def usable(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and the vector's integers floor(scale * x); vectors that are null, or hold null or non-finite components, are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & F.col("vec_id").isNotNull()).filter(fine)
        .select("vec_id", F.transform("x", lambda v: _floor(v * scale)).alias("x"))
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows as exact integers: int64, or Python integers if they do not fit it.  A missing component is 0."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    if out.size and np.abs(out).max() >= _FIT:
        return np.array([[int(v) for v in row] for row in out], dtype=object)
    return out.astype(np.int64)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense score arrays (queries x candidates), term at a time.

    Int32 if every partial sum surely fits, else int64, else Python integers clipped
    to 64 bits.
    """
    if queries.dtype == object or candidates.dtype == object:
        exact = queries.astype(object) @ candidates.T.astype(object)
        return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if bound >= _FIT:
        return accumulate(queries.astype(object), candidates)
    kind = np.int32 if bound < 1 << 31 else np.int64
    scores = np.zeros((len(queries), len(candidates)), dtype=kind)
    postings = []
    for term in range(candidates.shape[1]):
        weights = np.ascontiguousarray(candidates[:, term], dtype=kind)
        at = np.flatnonzero(weights)
        postings.append((at, weights[at]))
    for row, query in zip(scores, queries.astype(kind), strict=True):
        for term in np.flatnonzero(query).tolist():
            at, weights = postings[term]
            row[at] += weights * query[term]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best but ``own``; ``ids`` ascend, so ties go to the earlier place."""
    others = np.flatnonzero(ids != own)
    value = scores[others]
    if len(value) > k:
        least = np.partition(value, len(value) - k)[len(value) - k]
        above = np.flatnonzero(value > least)
        equal = np.flatnonzero(value == least)[: k - len(above)]
        others = others[np.sort(np.concatenate([above, equal]))]
        value = scores[others]
    return ids[others], value


def _cell(k: int):
    def run(_, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("vec_id", kind="stable")
            width = max(int(candidates["x"].map(len).max()), int(queries["x"].map(len).max()))
            ids, table = candidates["vec_id"].to_numpy(), _matrix(candidates["x"], width)
            step = max(1, (4 << 20) // len(ids))  # score arrays at once
            for at in range(0, len(queries), step):
                some = queries.iloc[at : at + step]
                for own, scores in zip(some["vec_id"].tolist(), accumulate(_matrix(some["x"], width), table), strict=True):
                    found, value = best(scores, ids, own, k)
                    out.append(pd.DataFrame({"query_id": np.full(len(found), own), "vec_id": found, "score": value.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("query_id", "vec_id", "score")})

    return run


def _blocks(rows: DataFrame, block: int) -> tuple[int, int]:
    """Number of rows, and of blocks of ``block`` bytes that they fill."""
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    return n, partitions_for(n * 8 * max(1, width or 1), block)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest integer inner products among all candidates but its own vec_id.

    Both sides are rows of :func:`usable`.  Ties go to the smaller vec_id.  Vectors of
    unequal length meet as if filled up with zeros.  Rows that repeat a vec_id with
    equal vectors are one; unequal vectors under one id are candidates each, and as
    queries give the best of their common list.  Empty sides give no rows.  Scores
    beyond 64 bits are clipped.
    """
    _, n_q = _blocks(queries, block)
    rows, n_c = _blocks(candidates, block)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_c = max(n_c, min(partitions_for(cores, n_q), partitions_for(rows, LEAST_ROWS)))
    # Blocks are numbers dealt by a hash of the id; each side is repeated once for every block of the other.
    left = queries.distinct().select("vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).alias("q")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"))
    right = candidates.distinct().select("vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(n_c)).cast("int").alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"))
    left, right = left.withColumn("q", F.col("q").cast("int")), right
    cells = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
