"""Sequence alignment: contiguous runs of frames that best match an ordered sequence of query vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import DimensionMismatch, RequestError
from tessera.functions import vectors as V
from tessera.operators.search import IDENTIFY_TIERS, in_tier, top

#: Least length of a query and the least distance of its anchors.
GAPS = ((48, 48), (32, 32), (16, 16), (0, 1))
ANCHORS = 3


def salient_anchors(sequence: Sequence[Sequence[float]], most: int = ANCHORS) -> list[int]:
    """Up to three offsets of the query by descending squared norm (earlier first), none nearer than the gap of its length."""
    if not sequence:
        return []
    gap = next(g for least, g in GAPS if len(sequence) >= least)
    order = sorted(range(len(sequence)), key=lambda i: (-math.fsum(x * x for x in sequence[i]), i))
    chosen: list[int] = []
    for i in order:
        if len(chosen) < min(most, len(sequence)) and all(abs(i - j) >= gap for j in chosen):
            chosen.append(i)
    return chosen


def positions(spark: SparkSession, sequence: Sequence[Sequence[float]]) -> DataFrame:
    """(pos, query) rows of a request's sequence."""
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(sequence)], "pos int, query array<double>")


#: Ids of a block of frames.
BLOCK = 4096


def _block_runs(sequence: np.ndarray, width: int, unit: str):
    """Of one block's frames and the border behind it, the runs that start in the block."""
    length, dim = sequence.shape

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_id").to_numpy(), kind="stable")
        ids = table.column("_id").to_numpy()[order]
        block = table.column("_block")[0].as_py()
        column = table.column("_vector").combine_chunks()
        if (column.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
            raise DimensionMismatch(f"frames of other than {dim} components")
        rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
        n = len(ids) - length + 1
        start = np.zeros(0, dtype=np.int64)
        total = np.zeros(0)
        if n > 0:
            at = np.flatnonzero((ids[length - 1 :] - ids[:n] == length - 1) & (ids[:n] // width == block))
            alike = np.concatenate(([0], np.cumsum(np.diff(ids) == 0)))  # an id that repeats makes no run
            at = at[alike[at + length - 1] == alike[at]]
            start, total = ids[at], np.zeros(len(at))
            for pos in range(length):  # in query order, each product in component order
                part = np.zeros(len(at))
                for d in range(dim):
                    part += rows[at + pos, d] * sequence[pos, d]
                total += part
        one = table.column(unit).combine_chunks()[:1]
        return pa.table({unit: one.take(pa.array(np.zeros(len(start), dtype=np.int64))), "start": pa.array(start), "score": pa.array(total / length)})

    return run


def runs(frames: DataFrame, sequence: Sequence[Sequence[float]], unit: str = "segment_id", key: str = "vector_id", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """(unit, start, score): every run of len(sequence) consecutive ids inside one unit, with the mean inner product in query order.

    Frames are dealt by blocks of ids, the first ones of a block also to the block
    before it, so that every run lies in one block; each frame travels once, but for
    those borders.  A null unit is the hot window; negative ids start no run.
    """
    length = len(sequence)
    width = max(block, 4 * length)
    queries = np.array([[float(x) for x in v] for v in sequence], dtype=np.float64)
    own = F.floor(F.col(key) / width).cast("long")
    before = F.when((F.pmod(F.col(key), F.lit(width)) < length - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = frames.filter(F.col(key) >= 0).select(unit, F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"), F.explode(before).alias("_block"))
    kind = frames.schema[unit].dataType.simpleString()
    return dealt.groupBy(unit, "_block").applyInArrow(_block_runs(queries, width, unit), f"{unit} {kind}, start long, score double")


def anchored_runs(frames: DataFrame, sequence: Sequence[Sequence[float]], candidates: int, unit: str = "segment_id", key: str = "vector_id", vector: str = "vector") -> DataFrame:
    """:func:`runs` of the starts that the anchors' best ``candidates`` frames name: fewer products, maybe not the best start."""
    starts = None
    for offset in salient_anchors(sequence):
        score = V.dot(vector, V.vector(sequence[offset])).alias("score")
        part = frames.select(unit, F.col(key).alias("_id"), score).orderBy(F.desc("score"), "_id").limit(candidates).select(unit, (F.col("_id") - offset).alias("start")).filter("start >= 0")
        starts = part if starts is None else starts.unionByName(part)
    wanted = starts.distinct().select(F.col(unit).alias("_unit"), "start", F.explode(F.sequence(F.lit(0), F.lit(len(sequence) - 1))).alias("pos"))
    here = frames.select(F.col(unit), F.col(key).alias("_id"), F.col(vector).alias("_vector"))
    met = here.join(F.broadcast(wanted), here[unit].eqNullSafe(F.col("_unit")) & (F.col("_id") == F.col("start") + F.col("pos")))
    met = met.join(F.broadcast(positions(frames.sparkSession, sequence)), "pos")
    grouped = met.select(unit, "start", "pos", V.dot("_vector", "query").alias("d")).groupBy(unit, "start").agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("parts"))
    return grouped.filter(F.size("parts") == len(sequence)).select(unit, "start", (F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["d"]) / len(sequence)).alias("score"))


def identify(frames: DataFrame, sequence: Sequence[Sequence[float]], dim: int, k: int = 5, tier: str = "all", include_metadata: bool = True, anchored: int = 0) -> DataFrame:
    """The identify request: (rank, start_id, score, start_timestamp_ms, duration_ms), best score of each start first.

    A run lies in one segment or in the hot window.  The timestamp is the start
    frame's, 0 without ``include_metadata``; the duration is always 0.  ``anchored``
    overrides exhaustive matching by that many candidates of each anchor.
    """
    if not sequence:
        raise RequestError("vectors must not be empty")
    chosen = in_tier(frames, tier, IDENTIFY_TIERS)
    if k == 0:
        found = chosen.limit(0).select(F.lit(0).alias("rank"), F.col("vector_id").alias("start_id"), F.lit(0.0).alias("score"))
    else:
        for i, v in enumerate(sequence):
            if len(v) != dim:
                raise DimensionMismatch(f"dimension mismatch: expected {dim}, got {len(v)} in vector {i}")
        matched = anchored_runs(chosen, sequence, anchored) if anchored else runs(chosen, sequence)
        best = matched.groupBy("start").agg(F.max("score").alias("score"))
        found = top(best, k, "start").select("rank", F.col("start").alias("start_id"), "score")
    if include_metadata:
        stamps = frames.select(F.col("vector_id").alias("start_id"), F.col("sequence_ts").alias("start_timestamp_ms")).join(F.broadcast(found.select("start_id")), "start_id", "left_semi").groupBy("start_id").agg(F.max("start_timestamp_ms").alias("start_timestamp_ms"))
        found = found.join(stamps, "start_id", "left").withColumn("start_timestamp_ms", F.coalesce("start_timestamp_ms", F.lit(0)).cast("long"))
    else:
        found = found.withColumn("start_timestamp_ms", F.lit(0).cast("long"))
    return found.select("rank", "start_id", "score", "start_timestamp_ms", F.lit(0).cast("long").alias("duration_ms"))
