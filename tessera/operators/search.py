"""Exact similarity search: filters first, scores in one expression, top-k by a bounded sort.

Ties always go to the smaller id.  Every search here is exact; approximate paths are in
:mod:`tessera.operators.ann` and :mod:`tessera.operators.pq` and have to be asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import DimensionMismatch, RequestError
from tessera.functions import vectors as V
from tessera.functions.tags import tag_filter

METRICS: dict[str, Callable[..., Column]] = {"ip": V.dot, "cosine": V.cosine, "l2": lambda a, b: -V.l2_squared(a, b)}
#: Rows of a query batch that are broadcast at most, in bytes; larger batches are dealt in blocks.
BROADCAST_BYTES = 8 << 20

#: Which rows a tier holds, by level: null is the hot window, 0 to 2 are segments; pq says whether they are quantised.
QUERY_TIERS = {"active": "level is null or (level <= 1 and not pq)", "all": "true", "archive": "level >= 2 or pq"}
IDENTIFY_TIERS = {"active": "level is null or (level <= 1 and not pq)", "all": "true", "archive": "pq"}


def top(scored: DataFrame, k: int, key: str = "vector_id") -> DataFrame:
    """``scored`` by score, then id, with a rank from 1: the k first."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows: one task is enough


def topk(rows: DataFrame, query: Sequence[float], k: int, metric: str = "ip", key: str = "vector_id", vector: str = "vector") -> DataFrame:
    """(rank, key, score) of the k rows most like ``query``."""
    if metric not in METRICS:
        raise RequestError(f"unknown metric {metric!r}")
    if k == 0:
        return rows.limit(0).select(F.lit(0).alias("rank"), key, F.lit(0.0).alias("score"))
    scored = rows.filter(F.col(vector).isNotNull()).select(key, METRICS[metric](vector, V.vector(query)).alias("score"))
    return top(scored.filter(~F.isnan("score")), k, key).select("rank", key, "score")


def score_by_id(rows: DataFrame, query: Sequence[float], ids: DataFrame, key: str = "vector_id", vector: str = "vector") -> DataFrame:
    """(key, score) of each of ``ids``; a null score where there is no such row."""
    scored = rows.join(ids.select(key).distinct(), key, "left_semi").select(key, V.dot(vector, V.vector(query)).alias("score"))
    return ids.select(key).distinct().join(scored, key, "left")


def merge_best(*parts: DataFrame, key: str = "vector_id") -> DataFrame:
    """The best score of each id over all parts."""
    out = parts[0].select(key, "score")
    for part in parts[1:]:
        out = out.unionByName(part.select(key, "score"))
    return out.groupBy(key).agg(F.max("score").alias("score"))


#: Scores that a task holds at once.
SCORES = 4 << 20


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, key, score) rows the k best of each query, ties to the smaller key."""
    order = np.lexsort((key, -score, query))
    query, key, score = query[order], key[order], score[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < k], key[place < k], score[place < k]


def _products(queries: np.ndarray, rows: np.ndarray, ordered: bool) -> np.ndarray:
    """Inner products; ``ordered``: summed in component order, as an expression would."""
    if not ordered:
        return queries @ rows.T
    out = np.zeros((len(queries), len(rows)))
    for d in range(rows.shape[1]):
        out += np.multiply.outer(queries[:, d], rows[:, d])
    return out


def best_of_units(scored: DataFrame, k: int, key: str = "vector_id", unit: str = "segment_id") -> DataFrame:
    """(key, score): rows among which the k best ids are, each with its best score.

    An id occurs once in a unit, so what is among the k best ids is among the k best of
    its unit; each partition sends on k rows of a unit at most, and only those are
    grouped by id.
    """
    window = Window.partitionBy(unit).orderBy(F.desc("score"), key)
    return merge_best(scored.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") <= k), key=key)


def _score_blocks(queries: np.ndarray, ids: np.ndarray, k: int, ordered: bool):
    """Each block of rows against blocks of queries, SCORES at once; what may be among a query's k best joins what it has so far."""
    dim = queries.shape[1]
    step = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                column = part.column("vector")
                if len(part) and (np.diff(column.offsets.to_numpy()) != dim).any():
                    raise DimensionMismatch(f"rows of other than {dim} components")
                rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                keys = part.column("key").to_numpy()
                for lo in range(0, len(queries), max(1, SCORES // step)):
                    scores = _products(queries[lo : lo + max(1, SCORES // step)], rows, ordered)
                    if len(keys) > k:
                        least = np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k]
                        which, place = np.nonzero(scores >= least[:, None])
                    else:
                        which, place = np.divmod(np.arange(scores.size), max(1, len(keys)))
                    found = which + lo, keys[place], scores[which, place]
                    best = tuple(np.concatenate(x) for x in zip(best, found, strict=True))
                best = _best(*best, k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "key", "score"])

    return run


def batch_topk(rows: DataFrame, queries: DataFrame, k: int, key: str = "vector_id", vector: str = "vector", pad: bool = False) -> DataFrame:
    """(query_id, rank, key, score): k best rows for each query (query_id, query) by inner product, summed in component order.

    :func:`batch_topk_blocks` with ordered sums.  With ``pad``, queries with fewer rows
    are filled up to k with id -1 and a score of minus infinity.
    """
    best = batch_topk_blocks(rows, queries, k, key, vector, ordered=True)
    if not pad:
        return best
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    filled = slots.join(best, ["query_id", "rank"], "left")
    return filled.select("query_id", "rank", F.coalesce(key, F.lit(-1)).alias(key), F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def batch_topk_blocks(rows: DataFrame, queries: DataFrame, k: int, key: str = "vector_id", vector: str = "vector", ordered: bool = False) -> DataFrame:
    """(query_id, rank, key, score): k best rows for each query by matrix products, a bounded block of queries at a time.

    A block of queries of about BROADCAST_BYTES, counted, goes to every task with the
    plan; the collection stays where it is, and a task keeps k rows of each query, so
    k * tasks rows of each query are shuffled, whatever the number of rows.  Rows of
    another length than the queries raise; null vectors are left out.
    """
    first = queries.select(F.size("query").alias("dim")).first()
    if first is None:
        return queries.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score"))
    dim = first["dim"]
    each = max(1, BROADCAST_BYTES // (8 * dim))
    table = rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    found = None
    total = queries.count()
    blocks = -(-total // each)
    numbered = queries.select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    for block in range(blocks):
        own = numbered.filter(F.col("block") == block).select("query_id", "query").toPandas()  # about BROADCAST_BYTES
        if own.empty:
            continue
        if own["query"].map(len).ne(dim).any():
            raise DimensionMismatch(f"queries of other than {dim} components")
        matrix = np.array([*own["query"]], dtype=np.float64)
        part = table.mapInArrow(_score_blocks(matrix, own["query_id"].to_numpy(dtype=np.int64), k, ordered), "query_id long, key long, score double")
        found = part if found is None else found.unionByName(part)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")


def envelope(found: DataFrame, metadata: DataFrame, key: str = "vector_id") -> DataFrame:
    """``found`` with entity_id, sequence_ts, tags and payload_base64 of its ids; rows without metadata have nulls."""
    meta = metadata.select(F.col(key), "entity_id", "sequence_ts", "tags", F.base64("payload").alias("payload_base64"))
    # At most k rows are looked up; the store is scanned for them, not shuffled.
    have = meta.join(F.broadcast(found), key)
    none = found.join(have.select(key), key, "left_anti").withColumns({c: F.lit(None).cast(t) for c, t in meta.dtypes if c != key})
    return have.select(none.columns).unionByName(none)


def in_tier(rows: DataFrame, tier: str, tiers: dict[str, str]) -> DataFrame:
    if tier not in tiers:
        raise RequestError(f"unknown tier {tier!r}")
    return rows.filter(tiers[tier])


def query(rows: DataFrame, vector: Sequence[float], dim: int, k: int = 10, tags_all: Sequence[str] = (), tags_any: Sequence[str] = (), tier: str = "active", include_metadata: bool = True) -> DataFrame:
    """The query request: tier, tag filter, inner product, best score of each id, top k, metadata of those only.

    ``rows``: vector_id, vector, tags, level, pq, and the metadata columns; with
    segment_id (null: hot), ids are unique in each segment.  A filter that cannot be
    resolved raises; it never falls back to no filter.
    """
    if len(vector) != dim:
        raise DimensionMismatch(f"dimension mismatch: expected {dim}, got {len(vector)}")
    chosen = in_tier(rows, tier, QUERY_TIERS)
    predicate = tag_filter("tags", tags_all, tags_any)
    if predicate is not None:
        chosen = chosen.filter(predicate)
    units = "segment_id" in chosen.columns
    scored = chosen.select("vector_id", *(["segment_id"] if units else []), V.dot("vector", V.vector(vector)).alias("score"))
    if not k:
        best = scored.limit(0).select(F.lit(0).alias("rank"), "vector_id", "score")
    else:
        best = top(best_of_units(scored, k) if units else merge_best(scored), k).select("rank", "vector_id", "score")
    if not include_metadata:
        return best
    if units:  # of rows in several units the newest tells the metadata: the hot window, then the latest segment
        newest = Window.partitionBy("vector_id").orderBy(F.col("segment_id").isNotNull(), F.desc("segment_id"))
        chosen = chosen.join(F.broadcast(best.select("vector_id")), "vector_id", "left_semi").withColumn("_place", F.row_number().over(newest)).filter("_place = 1")
        return envelope(best, chosen)
    return envelope(best, chosen).dropDuplicates(["vector_id"])


def overlay_capacity(asked: int) -> int:
    """0 stands for 1024; 65,536 at most."""
    return min(asked or 1024, 65_536)


def overlay_topk(base: DataFrame, overlay: DataFrame, query: Sequence[float], k: int, capacity: int = 0, key: str = "vector_id", vector: str = "vector") -> DataFrame:
    """(rank, key, score): top k of an immutable base and an overlay of which the ``capacity`` newest (largest) ids count.

    Rows and query are normalised.
    """
    kept = overlay.orderBy(F.desc(key)).limit(overlay_capacity(capacity))
    unit = V.normalize(V.vector(query))
    scored = base.select(key, vector).unionByName(kept.select(key, vector)).select(key, V.dot(V.normalize(vector), unit).alias("score"))
    return top(scored, k, key).select("rank", key, "score")
