"""Tags: normal form, validation, filters and posting lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import col

#: Limits and characters of a tag.
MOST_TAGS, MOST_BYTES = 64, 64
_ALLOWED = r"^[A-Za-z0-9_\-./:]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(tag: Column) -> Column:
    """Trimmed of white space, A-Z lower-cased."""
    return F.translate(F.regexp_replace(tag, r"(?U)^\s+|\s+$", ""), _UPPER, _LOWER)


def normalize_tags(tags: str | Column) -> Column:
    """Normal forms, blanks and nulls dropped, sorted, distinct; null gives none."""
    some = F.filter(F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), normal), lambda t: t.isNotNull() & (t != ""))
    return F.array_sort(F.array_distinct(some))


def invalid_tags(tags: str | Column) -> Column:
    """What is wrong with a tag list, or null: too many, too long, or other characters.  Blanks are no tags."""
    some = F.filter(F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t.isNotNull() & (t != ""))
    return (
        F.when(F.size(col(tags)) > MOST_TAGS, F.lit("too many tags"))
        .when(F.exists(some, lambda t: F.octet_length(t) > MOST_BYTES), F.lit("tag too long"))
        .when(F.exists(some, lambda t: ~t.rlike(_ALLOWED)), F.lit("invalid characters"))
    )


def normal_list(tags: Sequence[str]) -> list[str]:
    """:func:`normalize_tags` of a request's own list."""
    lowered = (t.strip().translate(str.maketrans(_UPPER, _LOWER)) for t in tags)
    return sorted({t for t in lowered if t})


def tag_filter(tags: str | Column, all_of: Sequence[str] = (), any_of: Sequence[str] = ()) -> Column | None:
    """Predicate on a normalised tag column; None if nothing is asked.

    A list of blanks asks for nothing in ``all_of``, but for one of no tags in ``any_of``.
    """
    terms = []
    if wanted := normal_list(all_of):
        terms.append(F.size(F.array_except(F.array(*map(F.lit, wanted)), col(tags))) == 0)
    if any_of:
        wanted = normal_list(any_of)
        terms.append(F.arrays_overlap(col(tags), F.array(*map(F.lit, wanted))) if wanted else F.lit(False))
    if not terms:
        return None
    return terms[0] if len(terms) == 1 else terms[0] & terms[1]


def postings(rows: DataFrame, key: str = "vector_id", tags: str = "tags") -> DataFrame:
    """tag, ids (ascending): rows of each tag."""
    return rows.select(F.explode(F.array_distinct(tags)).alias("tag"), F.col(key)).groupBy("tag").agg(F.sort_array(F.collect_list(key)).alias("ids"))


def bitmaps(rows: DataFrame, key: str = "vector_id", tags: str = "tags") -> DataFrame:
    """tag, bucket, bitmap: posting lists as bitmaps of 32,768 ids each."""
    exploded = rows.select(F.explode(F.array_distinct(tags)).alias("tag"), F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit"))
    return exploded.groupBy("tag", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _joined(maps: DataFrame, tags: Sequence[str], agg) -> DataFrame:
    own = maps.filter(F.col("tag").isin(normal_list(tags)))
    return own.groupBy("bucket").agg(agg("bitmap").alias("bitmap"), F.count("*").alias("tags"))


def bitmap_union(maps: DataFrame, tags: Sequence[str]) -> DataFrame:
    """bucket, bitmap of the ids with any of ``tags``."""
    return _joined(maps, tags, F.bitmap_or_agg).select("bucket", "bitmap")


def bitmap_intersection(maps: DataFrame, tags: Sequence[str]) -> DataFrame:
    """bucket, bitmap of the ids with all of ``tags``."""
    own = _joined(maps, tags, F.bitmap_and_agg)
    return own.filter(F.col("tags") == len(normal_list(tags))).select("bucket", "bitmap")


def bitmap_cardinality(maps: DataFrame) -> DataFrame:
    return maps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("cardinality"))


def allocate_tag_ids(registry: DataFrame, tags: DataFrame, most: int = 500_000) -> DataFrame:
    """tag_id and tag of ``registry`` and, numbered on from its largest id in order of the tag, those that ``tags`` (column tag) adds.

    Raises if the registry would exceed ``most``.  Distinct tags are bounded by it,
    so numbering them in one window is too.
    """
    from pyspark.sql import Window

    from tessera.errors import Overloaded

    new = tags.select("tag").distinct().join(registry.select("tag"), "tag", "left_anti")
    have = registry.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("top"), F.count("*").alias("n")).first()
    if have["n"] + new.count() > most:
        raise Overloaded(f"tag_registry_overflow: over {most} tags")
    numbered = new.select((F.row_number().over(Window.orderBy("tag")) + have["top"]).cast("long").alias("tag_id"), "tag")
    return registry.select(F.col("tag_id").cast("long").alias("tag_id"), "tag").unionByName(numbered)
