"""Idempotent append with dense, monotonic ids."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import Conflict
from tessera.functions.tags import normalize_tags


def idempotency_key(key: str | Column = "idempotency_key") -> Column:
    """Trimmed; blank is none."""
    trimmed = F.regexp_replace(F.col(key) if isinstance(key, str) else key, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the folder in ``spark.checkpoint.dir``; where that is unset, to the warehouse, which a cluster shares too."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or rows.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-checkpoints")
    return rows.checkpoint()


def dense_numbers(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``rows`` with ``name`` = start, start + 1, ... in ``order``: ranges are sorted apart and shifted by the counts before them.

    No task holds more than a range of the rows; one count a partition reaches the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, total = [], start
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")


def first_of_key(batch: DataFrame, order: str = "ord") -> DataFrame:
    """``batch`` with key (normal form) and lead: the order of the first row with that key, its own without a key."""
    keyed = batch.withColumn("key", idempotency_key())
    first = keyed.filter("key is not null").groupBy("key").agg(F.min(order).alias("lead"))
    return keyed.join(first, "key", "left").withColumn("lead", F.coalesce("lead", order))


def append(existing: DataFrame, batch: DataFrame, next_id: int | None = None, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(acks, new rows) of an idempotent append.

    ``existing``: vector_id, idempotency_key.  ``batch``: a unique ``order``,
    idempotency_key and anything else.  Acks are (order, id, created): a key that is
    stored, or came earlier in the batch, gets the first id and changes nothing.
    """
    stored = existing.select(F.col("vector_id").alias("_stored"), idempotency_key().alias("key")).filter("key is not null")
    marked = first_of_key(batch, order).join(stored, "key", "left")
    if next_id is None:
        next_id = existing.agg(F.coalesce(F.max("vector_id") + 1, F.lit(0))).first()[0]
    fresh = marked.filter(F.col("_stored").isNull() & (F.col(order) == F.col("lead")))
    new = dense_numbers(fresh.drop("_stored", "lead"), [order], "vector_id", next_id)
    ids = new.select(F.col(order).alias("lead"), F.col("vector_id").alias("_new"))
    acks = marked.join(ids, "lead", "left").select(
        order, F.coalesce("_stored", "_new").alias("id"), (F.col("_stored").isNull() & (F.col(order) == F.col("lead"))).alias("created"))
    return acks, new.drop("idempotency_key").withColumnRenamed("key", "idempotency_key")


def with_defaults(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Missing fields of an ingest row: entity_id and sequence_ts are the row's order, payload empty, tags none; tags in normal form."""
    out = rows
    for name, kind in (("entity_id", "long"), ("sequence_ts", "long")):
        out = out.withColumn(name, F.coalesce(F.col(name) if name in rows.columns else F.lit(None), F.col(order)).cast(kind))
    out = out.withColumn("payload", F.coalesce(F.col("payload").cast("binary") if "payload" in rows.columns else F.lit(None).cast("binary"), F.lit(b"")))
    out = out.withColumn("tags", normalize_tags("tags") if "tags" in rows.columns else F.array().cast("array<string>"))
    return out if "idempotency_key" in rows.columns else out.withColumn("idempotency_key", F.lit(None).cast("string"))


def check_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, or Conflict if a non-null key repeats."""
    twice = rows.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise Conflict(f"{', '.join(f'{k} {twice[0][k]}' for k in keys)} is taken")
    return rows


def upsert(rows: DataFrame, changes: DataFrame, key: str = "vector_id") -> DataFrame:
    """``rows`` with those of ``changes`` instead where the key is the same."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes.select(rows.columns))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    names = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max(F.struct(order, *(c for c in names if c != order))).alias("r"))
    return picked.select(key, *(F.col(f"r.{c}").alias(c) for c in names))


def counter(rows: DataFrame, floor: int = 0) -> int:
    """The next id: past the largest, and never below ``floor``."""
    return max(floor, rows.agg(F.coalesce(F.max("vector_id") + 1, F.lit(0))).first()[0])


def id_gaps(rows: DataFrame, key: str = "vector_id") -> DataFrame:
    """(previous, key) of neighbours that do not follow each other, and of repeated ids.

    Ids are compared inside ranges of 65,536 and across their borders, so that no
    window spans the whole table.
    """
    block = F.shiftright(F.col(key), 16)
    inside = rows.select(key, block.alias("block")).withColumn("previous", F.lag(key).over(Window.partitionBy("block").orderBy(key)))
    bounds = rows.groupBy(block.alias("block")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    border = bounds.withColumn("previous", F.lag("hi").over(Window.orderBy("block"))).select(F.col("previous"), F.col("lo").alias(key))  # a row for 65,536 ids
    return inside.filter(F.col("previous").isNotNull()).select("previous", key).unionByName(border.filter("previous is not null")).filter(F.col(key) - F.col("previous") != 1)
