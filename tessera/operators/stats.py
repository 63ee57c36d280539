"""Counters and distributions of a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in microseconds.
BUCKETS = (10, 25, 50, 100, 500, 1000)


def summary(vectors: DataFrame, segments: DataFrame, wal: DataFrame, jobs: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row of counts, each from one aggregated scan."""
    counts = [
        segments.agg(*(F.count_if(F.col("state") == s).alias(f"segments_{s}") for s in ("active", "building", "obsolete", "failed"))),
        vectors.agg(F.count("*").alias("total_vectors"), F.count_if(F.col("level").isNull()).alias("hot_vectors")),
        wal.agg(F.count_if(F.col("checkpointed_at").isNull()).alias("wal_pending")),
        jobs.agg(F.count_if(F.col("state").isin("queued", "running")).alias("jobs_in_flight")),
        quarantine.agg(F.count("*").alias("quarantine_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("quarantine_bytes")),
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.join(part)  # one row each
    return out


def latency_histogram(rows: DataFrame, value: str | Column, bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """(le, count): observations up to each bound, and all at +Inf; one pass, whatever the number of bounds."""
    v = F.col(value) if isinstance(value, str) else value
    counts = rows.agg(*(F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(v).alias("all"))
    named = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    return counts.select(F.inline(F.array(*named, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count")))))


def hit_ratio(hits: str | Column, misses: str | Column) -> Column:
    """Share of hits; 1 without lookups."""
    h, m = (F.col(x) if isinstance(x, str) else x for x in (hits, misses))
    return F.when(h + m == 0, F.lit(1.0)).otherwise(h.cast("double") / (h + m))


def percentiles(rows: DataFrame, value: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles: p50, p95, p99."""
    return rows.agg(*(F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(100 * p)}") for p in shares))


def memory_bytes(dim: int, m: int = 16) -> Column:
    """Estimated bytes of a hot row: vector, metadata (tags and payload columns), and links of its graph node."""
    return F.lit(4 * dim + 8 * 2 * m + 64) + F.coalesce(F.octet_length("payload"), F.lit(0)) + 4 * F.coalesce(F.size("tags"), F.lit(0))


def hot_window(rows: DataFrame) -> DataFrame:
    """(first_id, end_id): the hot rows' id range, its end excluded."""
    return rows.filter("level is null").agg(F.min("vector_id").alias("first_id"), (F.max("vector_id") + 1).alias("end_id"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """Exposition lines of (name, labels map, value) rows."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise("")
    return metrics.select(F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
