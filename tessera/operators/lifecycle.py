"""Segments: checkpoint, compaction, replay, recovery and quarantine, as functions of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import SparseIds
from tessera.operators.ingest import id_gaps, latest

#: Rows of one checkpoint, segments of one compaction, backlog that defers it, quarantine limits.
CHECKPOINT_ROWS, MOST_INPUTS, BUSY_WAL = 50_000, 8, 4096
QUARANTINE_FILES, QUARANTINE_BYTES, QUARANTINE_HOURS = 50, 5 << 30, 168


def pending(wal: DataFrame, limit: int = CHECKPOINT_ROWS) -> DataFrame:
    """The oldest rows that no segment holds yet."""
    return wal.filter("checkpointed_at is null").orderBy("lsn").limit(limit)


def after_lsn(wal: DataFrame, lsn: int) -> DataFrame:
    return wal.filter("checkpointed_at is null").filter(F.col("lsn") > lsn)


def densify(rows: DataFrame, key: str = "vector_id") -> DataFrame:
    """``rows``, or SparseIds if ids repeat or leave gaps."""
    bad = id_gaps(rows, key).limit(1).collect()
    if bad:
        kind = "duplicate vector id" if bad[0][key] == bad[0]["previous"] else "sparse vector id gap"
        raise SparseIds(f"{kind}: {bad[0][key]} follows {bad[0]['previous']}")
    return rows


def newest_wins(rows: DataFrame, key: str = "vector_id", start: str = "segment_start") -> DataFrame:
    """One row of each id: that of the segment that begins last."""
    return latest(rows, key, start)


@dataclass(frozen=True)
class Plan:
    """A compaction: the inputs' segment ids, and the level they make."""

    inputs: tuple[int, ...]
    level: int


def pick_compaction(segments: DataFrame, wal_pending: int = 0) -> Plan | str:
    """What to compact, or why nothing: two segments of level 0 make level 1, else two of level 1 make level 2; the earliest eight at most.

    The segment table is the catalog: a row for each segment.
    """
    if wal_pending >= BUSY_WAL:
        return "wal_backlog"
    active = segments.filter("state = 'active' and level < 2")
    for level in (0, 1):
        own = [r["segment_id"] for r in active.filter(F.col("level") == level).orderBy("start_id", "segment_id").limit(MOST_INPUTS).collect()]
        if len(own) >= 2:
            return Plan(tuple(own), level + 1)
    return "too_few_segments"


def compaction_candidates(segments: DataFrame) -> DataFrame:
    """(segment_id, level, output_level) that :func:`pick_compaction` names, as a plan."""
    active = segments.filter("state = 'active' and level < 2")
    placed = active.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("start_id", "segment_id")))
    enough = active.groupBy("level").agg(F.count("*").alias("n")).filter("n >= 2").agg(F.min("level").alias("chosen"))
    return placed.join(F.broadcast(enough), F.col("level") == F.col("chosen")).filter(F.col("place") <= MOST_INPUTS).select("segment_id", "level", (F.col("level") + 1).alias("output_level"))


def replay(wal: DataFrame, metadata: DataFrame, segments: DataFrame, lsn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wal, metadata, segments) as of ``lsn``: later entries and their metadata go, all entries are pending again, active segments obsolete."""
    kept = wal.filter(F.col("lsn") <= lsn).withColumn("checkpointed_at", F.lit(None).cast(dict(wal.dtypes)["checkpointed_at"]))
    meta = metadata.join(kept.select("vector_id").distinct(), "vector_id", "left_semi")
    state = F.when(F.col("state") == "active", F.lit("obsolete")).otherwise(F.col("state"))
    return kept, meta, segments.withColumn("state", state)


def orphans(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Files that no living segment names."""
    living = segments.filter("state in ('active', 'building', 'pending_activate', 'compacting')")
    return files.join(living.select("path"), "path", "left_anti")


def evicted(quarantine: DataFrame, now: int, files: int = QUARANTINE_FILES, size: int = QUARANTINE_BYTES, hours: int = QUARANTINE_HOURS) -> DataFrame:
    """Quarantined files to delete: past their time, or beyond the newest ``files`` and ``size`` bytes.

    The quarantine is capped, so its running total is a window of bounded size.
    """
    newest = Window.orderBy(F.desc("quarantined_at"), F.desc("id"))
    run = quarantine.withColumn("place", F.row_number().over(newest)).withColumn("total", F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter((F.col("place") > files) | (F.col("total") > size) | (F.col("quarantined_at") < now - hours * 3600)).drop("place", "total")


def segment_ranges(rows: DataFrame) -> DataFrame:
    """(segment_id, start_id, end_id, rows) of each segment, the hot window as a null segment."""
    return rows.groupBy("segment_id").agg(F.min("vector_id").alias("start_id"), F.max("vector_id").alias("end_id"), F.count("*").alias("rows"))


def metadata_range(metadata: DataFrame, start: int, end: int) -> DataFrame:
    return metadata.filter(F.col("vector_id").between(start, end))


def tag_rows(metadata: DataFrame, tag_links: DataFrame) -> DataFrame:
    """vector_id and its tag ids as ascending, comma-joined text; empty without tags."""
    ids = tag_links.groupBy("vector_id").agg(F.sort_array(F.collect_set("tag_id")).alias("ids"))
    return metadata.select("vector_id").join(ids, "vector_id", "left").select("vector_id", F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("tag_ids"))
