"""Registered queries of the vector engine on the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars, tags
from tessera.functions import vectors as V
from tessera.operators import audio, dtw, identify, ingest, lifecycle, pq, search, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIM, K, LENGTH, BAND = 64, 10, 16, 8
WORLD = "label_1"


def register(sql: str = "", name: str = ""):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# -- the tables as a collection --------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of a collection: segments of 100 ids, the first four on disk (codes, raw level 2, 1 and 0), the rest hot."""
    seg = F.expr("cast(vec_id div 100 as bigint)")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("entity_id"), (F.col("vec_id") * 20).alias("sequence_ts"),
        F.array(F.concat(F.lit("label_"), F.col("label").cast("string")), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")).alias("tags"),
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).cast("binary").alias("payload"),
        F.when(seg < 4, seg).alias("segment_id"), F.when(seg < 2, 2).when(seg == 2, 1).when(seg == 3, 0).alias("level"), (seg == 0).alias("pq"))


COLLECTION = """c AS (
  SELECT vec_id AS vector_id, embedding::DOUBLE[] AS vector, label::BIGINT AS entity_id, vec_id * 20 AS sequence_ts,
    ['label_' || label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END] AS tags, encode('vec-' || vec_id) AS payload,
    CASE WHEN vec_id // 100 < 4 THEN vec_id // 100 END AS segment_id,
    CASE WHEN vec_id // 100 < 2 THEN 2 WHEN vec_id // 100 = 2 THEN 1 WHEN vec_id // 100 = 3 THEN 0 END AS level, vec_id // 100 = 0 AS pq
  FROM embeddings), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"""


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: the row with the smallest id."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def sequence(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """The query sequence: LENGTH frames from id 210 on."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").between(210, 209 + LENGTH)).orderBy("vec_id").collect()
    return [[float(x) for x in r["embedding"]] for r in rows]


SEQUENCE = f"s AS (SELECT vec_id - 210 AS pos, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id BETWEEN 210 AND {209 + LENGTH})"

# -- similarity ------------------------------------------------------------------


def _top_sql(score: str, where: str = "true", source: str = "c, q") -> str:
    return f"""WITH {COLLECTION}, r AS (SELECT vector_id, {score} AS score FROM {source} WHERE {where})
SELECT rank::INTEGER AS rank, vector_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vector_id) AS rank FROM r) WHERE rank <= {K}"""


_IP = "list_inner_product(vector, v)"
_L2 = "list_sum(list_transform(list_zip(vector, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NORM = "list_sum(list_transform(vector, lambda x: x * x))"


def _topk(metric: str) -> Query:
    return lambda spark, sf_dir: search.topk(collection(spark, sf_dir), probe(spark, sf_dir), K, metric)


register(_top_sql(_IP), "topk_ip")(_topk("ip"))
register(_top_sql(f"-{_L2}"), "topk_l2")(_topk("l2"))
register(_top_sql(f"{_IP} / (sqrt({_NORM}) * sqrt(list_sum(list_transform(v, lambda x: x * x))))"), "topk_cosine")(_topk("cosine"))


@register(f"""WITH {COLLECTION}, r AS (
  SELECT a.vector_id AS query_id, c.vector_id, list_inner_product(a.vector, c.vector) AS score FROM c a, c WHERE a.vector_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vector_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM r) WHERE rank <= {K}""")
def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collection(spark, sf_dir)
    return search.batch_topk(rows, rows.filter("vector_id % 50 = 0").select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query")), K)


@register(ORACLES["batch_topk"].replace("score FROM (SELECT", "round(score, 9) AS score FROM (SELECT"))
def batch_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collection(spark, sf_dir)
    queries = rows.filter("vector_id % 50 = 0").select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query"))
    return search.batch_topk_blocks(rows, queries, K).withColumn("score", F.round("score", 9))


def _filtered(name: str, where: str, tags_all: Sequence[str] = (), tags_any: Sequence[str] = (), tier: str = "all") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.query(collection(spark, sf_dir), probe(spark, sf_dir), DIM, K, tags_all, tags_any, tier, include_metadata=False)

    register(_top_sql(_IP, where), name)(run)


_filtered("filtered_topk_all", f"list_has_all(tags, ['{WORLD}', 'even'])", [WORLD, " Even "])
_filtered("filtered_topk_any", "list_has_any(tags, ['label_1', 'label_3'])", (), ["label_1", "LABEL_3", "none"])
_filtered("filtered_topk_combo", "list_has_any(tags, ['label_1', 'label_2']) AND list_contains(tags, 'odd')", ["odd"], ["label_1", "label_2"])
_filtered("filtered_topk_unknown_all", "false", ["even", "unknown"])
_filtered("filtered_topk_unknown_any", "false", (), ["unknown"])
_filtered("filtered_topk_blank_all", "true", ["  "])
_filtered("filtered_topk_blank_any", "false", (), ["  "])
_filtered("tiered_active", "level IS NULL OR (level <= 1 AND NOT pq)", tier="active")
_filtered("tiered_all", "true", tier="all")
_filtered("tiered_archive", "level >= 2 OR pq", tier="archive")


@register(f"""WITH {COLLECTION}, r AS (SELECT vector_id, list_inner_product(vector, v) AS score FROM c, q WHERE list_contains(tags, 'even')),
m AS (SELECT *, row_number() OVER (ORDER BY score DESC, vector_id) AS rank FROM r)
SELECT rank::INTEGER AS rank, vector_id, score, entity_id, sequence_ts, array_to_string(tags, ',') AS tags, to_base64(payload) AS payload_base64 FROM m JOIN c USING (vector_id) WHERE rank <= {K}""")
def topk_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query(collection(spark, sf_dir), probe(spark, sf_dir), DIM, K, ["even"], tier="all").withColumn("tags", F.array_join("tags", ","))


@register(f"""WITH {COLLECTION} SELECT vector_id, max(score) AS score FROM (
  SELECT vector_id, list_inner_product(vector, v) AS score FROM c, q UNION ALL
  SELECT vector_id, list_inner_product(vector, v) * 0.5 FROM c, q WHERE level IS NOT NULL) GROUP BY vector_id""")
def merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = collection(spark, sf_dir).select("vector_id", "level", V.dot("vector", V.vector(probe(spark, sf_dir))).alias("score"))
    return search.merge_best(scored, scored.filter("level is not null").withColumn("score", F.col("score") * 0.5))


@register(f"""WITH {COLLECTION}, w AS (SELECT unnest([0, 7, 99999999, 7])::BIGINT AS vector_id)
SELECT DISTINCT w.vector_id, list_inner_product(c.vector, v) AS score FROM w CROSS JOIN q LEFT JOIN c USING (vector_id)""")
def score_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(0,), (7,), (99_999_999,), (7,)], "vector_id long")
    return search.score_by_id(collection(spark, sf_dir), probe(spark, sf_dir), ids)


@register(f"""WITH {COLLECTION} SELECT vector_id, {_NORM} AS norm_squared, sqrt({_NORM}) AS norm, abs({_NORM} - 1.0) < 1e-4 AS unit FROM c""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir).select("vector_id", V.norm_squared("vector").alias("norm_squared"), V.norm("vector").alias("norm"), V.is_normalized("vector").alias("unit"))


@register(f"""WITH {COLLECTION}, d AS (SELECT vector_id, list_transform(vector, lambda x: CASE WHEN vector_id % 3 = 0 THEN 0.0 ELSE 3 * x END) AS vector FROM c)
SELECT vector_id, list_sum(list_transform(CASE WHEN sqrt({_NORM}) > {V.EPSILON!r} THEN list_transform(vector, lambda x: x / sqrt({_NORM})) ELSE vector END, lambda y: y)) AS total FROM d""".replace("{_NORM}", _NORM))
def normalize_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = collection(spark, sf_dir).select("vector_id", F.transform("vector", lambda x: F.when(F.col("vector_id") % 3 == 0, F.lit(0.0)).otherwise(3 * x.cast("double"))).alias("vector"))
    return scaled.select("vector_id", F.aggregate(V.normalize("vector"), F.lit(0.0), lambda s, x: s + x).alias("total"))


_UNIT = "list_transform({0}, lambda x: x / sqrt(list_sum(list_transform({0}, lambda y: y * y))))"


@register(f"""WITH {COLLECTION}, o AS (SELECT * FROM c WHERE segment_id IS NULL ORDER BY vector_id DESC LIMIT 50),
r AS (SELECT vector_id, list_inner_product({_UNIT.format('vector')}, {_UNIT.format('v')}) AS score FROM (SELECT * FROM c WHERE segment_id IS NOT NULL UNION ALL SELECT * FROM o), q)
SELECT rank::INTEGER AS rank, vector_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vector_id) AS rank FROM r) WHERE rank <= {K}""")
def overlay_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collection(spark, sf_dir)
    return search.overlay_topk(rows.filter("segment_id is not null"), rows.filter("segment_id is null"), probe(spark, sf_dir), K, 50).withColumn("score", F.round("score", 9))


# -- sequences -------------------------------------------------------------------

_RUNS = f"""p AS (SELECT segment_id, vector_id - pos AS start, pos, list_inner_product(vector, s.v) AS d FROM c, s WHERE vector_id - pos >= 0 AND {{where}}),
r AS (SELECT segment_id, start, list_sum(list(d ORDER BY pos)) / {LENGTH} AS score FROM p GROUP BY ALL HAVING count(*) = {LENGTH})"""
_IDENTIFY = f"""WITH {COLLECTION}, {SEQUENCE}, {_RUNS}, b AS (SELECT start, max(score) AS score FROM r GROUP BY start)
SELECT rank::INTEGER AS rank, start AS start_id, score, {{stamp}} AS start_timestamp_ms, 0::BIGINT AS duration_ms FROM (SELECT *, row_number() OVER (ORDER BY score DESC, start) AS rank FROM b) WHERE rank <= {{k}}"""


def _identify(name: str, where: str, k: int = 5, tier: str = "all", metadata: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return identify.identify(collection(spark, sf_dir), sequence(spark, sf_dir), DIM, k, tier, metadata)

    register(_IDENTIFY.format(where=where, k=k, stamp="start * 20" if metadata else "0::BIGINT"), name)(run)


_identify("identify_exact", "true", metadata=False)
_identify("identify_metadata", "true")
_identify("identify_k0", "true", 0)
_identify("identify_active", "(level IS NULL OR (level <= 1 AND NOT pq))", tier="active")
_identify("identify_archive", "pq", tier="archive")


@register(f"WITH {COLLECTION}, {SEQUENCE}, {_RUNS.format(where='true')} SELECT segment_id, start, score FROM r")
def identify_unit_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify.runs(collection(spark, sf_dir), sequence(spark, sf_dir))


@register(f"""WITH {SEQUENCE}, n AS (SELECT pos, list_sum(list_transform(v, lambda x: x * x)) AS e FROM s),
a AS (SELECT pos FROM n ORDER BY e DESC, pos LIMIT 1) SELECT pos::BIGINT AS anchor FROM a""")
def salient_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen frames keep anchors sixteen apart: one fits."""
    return spark.createDataFrame([(a,) for a in identify.salient_anchors(sequence(spark, sf_dir))], "anchor long")


# -- tags ------------------------------------------------------------------------

_DIRTY = "list_value(' ' || upper(event_type) || ' ', event_type, '', CASE WHEN event_id % 3 = 0 THEN 'b ad' ELSE 'z/' || user_id END, NULL)"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    own = F.when(F.col("event_id") % 3 == 0, "b ad").otherwise(F.concat(F.lit("z/"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.array(F.concat(F.lit(" "), F.upper(kind), F.lit(" ")), kind, F.lit(""), own, F.lit(None).cast("string")).alias("tags"))


_CLEAN = f"list_sort(list_distinct(list_filter(list_transform({_DIRTY}, lambda t: lower(trim(t))), lambda t: t IS NOT NULL AND t <> '')))"


@register(f"SELECT event_id, array_to_string({_CLEAN}, ',') AS tags FROM events")
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("event_id", F.array_join(tags.normalize_tags("tags"), ",").alias("tags"))


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'invalid characters' END AS problem FROM events")
def tag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("event_id", tags.invalid_tags("tags").alias("problem"))


@register(f"WITH {COLLECTION} SELECT tag, count(*) AS ids, min(vector_id) AS first_id, max(vector_id) AS last_id FROM (SELECT unnest(tags) AS tag, vector_id FROM c) GROUP BY tag")
def tag_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tags.postings(collection(spark, sf_dir))
    return lists.select("tag", F.size("ids").cast("long").alias("ids"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@register(f"""WITH {COLLECTION} SELECT (SELECT count(*) FROM c WHERE list_has_any(tags, ['label_1', 'even'])) AS any_of, (SELECT count(*) FROM c WHERE list_has_all(tags, ['label_1', 'even'])) AS all_of""")
def tag_bitmap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = tags.bitmaps(collection(spark, sf_dir))
    some, every = (tags.bitmap_cardinality(f(maps, ["label_1", "even"])) for f in (tags.bitmap_union, tags.bitmap_intersection))
    return some.withColumnRenamed("cardinality", "any_of").join(every.withColumnRenamed("cardinality", "all_of"))


@register("""SELECT row_number() OVER (ORDER BY tag) + 2 AS tag_id, tag FROM (SELECT DISTINCT event_type AS tag FROM events WHERE event_type <> 'click') UNION ALL SELECT 1, 'click' UNION ALL SELECT 2, 'kept'""")
def tag_registry_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([(1, "click"), (2, "kept")], "tag_id long, tag string")
    return tags.allocate_tag_ids(registry, table(spark, sf_dir, "events").select(F.col("event_type").alias("tag")))


# -- ingest ----------------------------------------------------------------------

#: props repeat as keys; every seventh row has a blank one; the store holds '{"k": 1}' as id 0 and ends at id 4.
_BATCH = """b AS (SELECT event_id AS ord, CASE WHEN event_id % 7 <> 0 THEN trim(props) END AS key FROM events),
f AS (SELECT ord, key, CASE WHEN key IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY key) END AS lead FROM b),
n AS (SELECT ord, key, 4 + row_number() OVER (ORDER BY ord) AS id FROM f WHERE ord = lead AND key IS DISTINCT FROM '{"k": 1}'),
a AS (SELECT f.ord, CASE WHEN f.key = '{"k": 1}' THEN 0 ELSE n.id END AS id, coalesce(f.ord = f.lead AND f.key IS DISTINCT FROM '{"k": 1}', false) AS created FROM f LEFT JOIN n ON n.ord = f.lead)"""


def _append(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    existing = spark.createDataFrame([(0, ' {"k": 1} '), (4, None)], "vector_id long, idempotency_key string")
    key = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("props")))
    return ingest.append(existing, table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), key.alias("idempotency_key"), "value"))


@register(f"WITH {_BATCH} SELECT * FROM a")
def ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append(spark, sf_dir)[0]


@register(f"WITH {_BATCH} SELECT n.id AS vector_id, n.key AS idempotency_key, value FROM n JOIN events ON event_id = ord")
def ingest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append(spark, sf_dir)[1].select("vector_id", "idempotency_key", "value")


@register(f"WITH {_BATCH} SELECT count(*) AS accepted, count(*) FILTER (created) AS created FROM a")
def ingest_ack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append(spark, sf_dir)[0].agg(F.count("*").alias("accepted"), F.count_if("created").alias("created"))


# -- lifecycle -------------------------------------------------------------------


@register("""SELECT previous, event_id AS vector_id FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS previous FROM (
  SELECT event_id FROM events WHERE event_id % 1000 <> 17 UNION ALL SELECT event_id FROM events WHERE event_id % 1000 = 5)) WHERE previous IS NOT NULL AND event_id - previous <> 1""")
def densify_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("vector_id"))
    return ingest.id_gaps(ids.filter("vector_id % 1000 <> 17").unionAll(ids.filter("vector_id % 1000 = 5")))


@register(f"WITH {COLLECTION} SELECT segment_id, min(vector_id) AS start_id, max(vector_id) AS end_id, count(*) AS rows FROM c GROUP BY segment_id")
def segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.segment_ranges(collection(spark, sf_dir))


#: Two overlapping generations of orders: the later one has every second id.
@register("""SELECT o_orderkey AS vector_id, CASE WHEN o_orderkey % 2 = 0 THEN 500 ELSE 0 END::BIGINT AS segment_start, CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS value FROM orders""")
def compaction_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vector_id"), F.lit(0).cast("long").alias("segment_start"), F.col("o_totalprice").alias("value"))
    new = old.filter("vector_id % 2 = 0").select("vector_id", F.lit(500).cast("long").alias("segment_start"), (-F.col("value")).alias("value"))
    return lifecycle.newest_wins(old.unionByName(new))


_SEGMENTS = "g AS (SELECT s_suppkey AS segment_id, (s_nationkey % 3)::INTEGER AS level, CASE WHEN s_suppkey % 4 = 0 THEN 'obsolete' ELSE 'active' END AS state, s_suppkey * 10 AS start_id, 'seg-' || s_suppkey AS path FROM supplier)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("segment_id"), (F.col("s_nationkey") % 3).cast("int").alias("level"), F.when(key % 4 == 0, "obsolete").otherwise("active").alias("state"), (key * 10).alias("start_id"), F.concat(F.lit("seg-"), key.cast("string")).alias("path"))


@register(f"""WITH {_SEGMENTS}, a AS (SELECT * FROM g WHERE state = 'active' AND level < 2),
l AS (SELECT min(level) AS level FROM (SELECT level FROM a GROUP BY level HAVING count(*) >= 2))
SELECT segment_id, level, level + 1 AS output_level FROM (SELECT a.*, row_number() OVER (PARTITION BY a.level ORDER BY start_id, segment_id) AS place FROM a JOIN l USING (level)) WHERE place <= {lifecycle.MOST_INPUTS}""")
def compaction_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.compaction_candidates(_segments(spark, sf_dir))


_LSN = "(SELECT max(event_id) // 2 FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    events = table(spark, sf_dir, "events")
    wal = events.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("vector_id"), "value", F.when(F.col("event_id") % 3 == 0, F.lit(1)).cast("long").alias("checkpointed_at"))
    meta = events.groupBy(F.col("user_id").alias("vector_id")).agg(F.max("ts").alias("ts"))
    return wal, meta, events.agg(F.max("event_id")).first()[0] // 2


@register(f"SELECT event_id AS lsn, user_id AS vector_id, value, NULL::BIGINT AS checkpointed_at FROM events WHERE event_id <= {_LSN}")
def replay_to_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal, meta, lsn = _log(spark, sf_dir)
    return lifecycle.replay(wal, meta, _segments(spark, sf_dir), lsn)[0]


@register(f"SELECT count(*) AS rows, min(user_id) AS first_id FROM (SELECT DISTINCT user_id FROM events WHERE event_id <= {_LSN})")
def replay_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal, meta, lsn = _log(spark, sf_dir)
    return lifecycle.replay(wal, meta, _segments(spark, sf_dir), lsn)[1].agg(F.count("*").alias("rows"), F.min("vector_id").alias("first_id"))


@register(f"WITH {_SEGMENTS} SELECT segment_id, level, CASE WHEN state = 'active' THEN 'obsolete' ELSE state END AS state, start_id, path FROM g")
def replay_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal, meta, lsn = _log(spark, sf_dir)
    return lifecycle.replay(wal, meta, _segments(spark, sf_dir), lsn)[2]


@register("SELECT event_id AS lsn, user_id AS vector_id, value FROM events WHERE event_id % 3 <> 0 AND event_id > 40")
def wal_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.after_lsn(_log(spark, sf_dir)[0], 40).select("lsn", "vector_id", "value")


@register("SELECT event_id AS lsn, user_id AS vector_id, value FROM (SELECT * FROM events WHERE event_id % 3 <> 0 ORDER BY event_id LIMIT 50000)")
def wal_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.pending(_log(spark, sf_dir)[0]).select("lsn", "vector_id", "value")


@register(f"WITH {_SEGMENTS} SELECT path, bytes FROM (SELECT 'seg-' || p_partkey AS path, p_size::BIGINT AS bytes FROM part) WHERE path NOT IN (SELECT path FROM g WHERE state = 'active')")
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("seg-"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("bytes"))
    return lifecycle.orphans(files, _segments(spark, sf_dir))


@register(f"""SELECT id, quarantined_at, bytes FROM (SELECT p_partkey AS id, p_partkey // 3 * 3600 AS quarantined_at, p_size::BIGINT AS bytes,
  row_number() OVER w AS place, sum(p_size) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM part WINDOW w AS (ORDER BY p_partkey // 3 * 3600 DESC, p_partkey DESC))
WHERE place > 50 OR total > 900 OR quarantined_at < 700000 - {lifecycle.QUARANTINE_HOURS} * 3600""")
def quarantine_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(key.alias("id"), (F.expr("p_partkey div 3") * 3600).alias("quarantined_at"), F.col("p_size").cast("long").alias("bytes"))
    return lifecycle.evicted(files, 700_000, size=900)


@register("""SELECT c_custkey AS vector_id, coalesce(string_agg(DISTINCT o_orderkey % 9, ',' ORDER BY o_orderkey % 9), '') AS tag_ids FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def tag_rows_per_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vector_id"), (F.col("o_orderkey") % 9).alias("tag_id"))
    return lifecycle.tag_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vector_id")), links)


@register("SELECT c_custkey AS vector_id, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_name END AS name FROM customer")
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vector_id"), F.col("c_name").alias("name"))
    return ingest.upsert(rows, rows.filter("vector_id % 5 = 0").withColumn("name", F.lit("changed")))


@register(f"WITH {COLLECTION} SELECT vector_id, entity_id, sequence_ts FROM c WHERE vector_id BETWEEN 90 AND 250")
def metadata_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.metadata_range(collection(spark, sf_dir), 90, 250).select("vector_id", "entity_id", "sequence_ts")


# -- statistics ------------------------------------------------------------------


@register(f"""WITH {COLLECTION}, {_SEGMENTS} SELECT
  (SELECT count(*) FROM g WHERE state = 'active') AS segments_active, (SELECT count(*) FROM g WHERE state = 'building') AS segments_building,
  (SELECT count(*) FROM g WHERE state = 'obsolete') AS segments_obsolete, (SELECT count(*) FROM g WHERE state = 'failed') AS segments_failed,
  (SELECT count(*) FROM c) AS total_vectors, (SELECT count(*) FROM c WHERE level IS NULL) AS hot_vectors, (SELECT count(*) FROM events WHERE event_id % 3 <> 0) AS wal_pending,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS jobs_in_flight, (SELECT count(*) FROM part) AS quarantine_files, (SELECT sum(p_size)::BIGINT FROM part) AS quarantine_bytes""")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("state"))
    files = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("bytes"))
    return stats.summary(collection(spark, sf_dir), _segments(spark, sf_dir), _log(spark, sf_dir)[0], jobs, files)


@register("SELECT le, count FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS le, count(*) FILTER (value <= {b}) AS count FROM events" for b in stats.BUCKETS) + " UNION ALL SELECT '+Inf', count(value) FROM events)")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency_histogram(table(spark, sf_dir, "events"), "value")


@register("SELECT user_id, CASE WHEN h + m = 0 THEN 1.0 ELSE h::DOUBLE / (h + m) END AS ratio FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS h, count(*) FILTER (event_type = 'view') AS m FROM events GROUP BY user_id)")
def cache_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("h"), F.count_if(F.col("event_type") == "view").alias("m"))
    return counts.select("user_id", stats.hit_ratio("h", "m").alias("ratio"))


@register("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(table(spark, sf_dir, "events"), "value")


@register(f"WITH {COLLECTION} SELECT min(vector_id) AS first_id, max(vector_id) + 1 AS end_id FROM c WHERE level IS NULL")
def hot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hot_window(collection(spark, sf_dir))


# -- time series -----------------------------------------------------------------


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, series): each user's values by time."""
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return grouped.select(F.col("user_id").alias("series_id"), F.transform("s", lambda e: e["value"]).alias("series"))


def _series_query(spark: SparkSession, sf_dir: str) -> list[float]:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("user_id")).first()[0]
    return [r["value"] for r in events.filter(F.col("user_id") == first).orderBy("ts", "event_id").collect()]


_SERIES = "t AS (SELECT user_id AS series_id, list(value ORDER BY ts, event_id) AS series FROM events GROUP BY user_id), z AS (SELECT series AS q FROM t ORDER BY series_id LIMIT 1)"
_DTW = f"""d AS (
  SELECT series_id, 0 AS i, list_concat([0.0::DOUBLE], list_transform(series, lambda x: 'inf'::DOUBLE)) AS r FROM {{source}}, z WHERE abs(len(series) - len(q)) <= {BAND}
  UNION ALL
  SELECT d.series_id, i + 1, list_reduce(list_transform(range(1, len(series) + 1), lambda j:
      [CASE WHEN abs(i + 1 - j) <= {BAND} THEN (q[i + 1] - series[j]) * (q[i + 1] - series[j]) ELSE 'inf'::DOUBLE END, least(r[j], r[j + 1])]),
    lambda a, x: list_append(a, x[1] + least(x[2], a[len(a)])), ['inf'::DOUBLE])
  FROM d JOIN t USING (series_id), z WHERE i < len(q)),
e AS (SELECT series_id, r[len(r)] AS distance FROM d, z WHERE i = len(q))"""
_PROXY = "(SELECT series_id, list_sum(list_transform(range(1, least(len(series), len(q)) + 1), lambda j: (series[j] - q[j]) * (series[j] - q[j]))) + abs(len(series) - len(q)) AS distance FROM t, z)"
_RANKED = "SELECT rank::INTEGER AS rank, series_id, distance FROM (SELECT *, row_number() OVER (ORDER BY distance, series_id) AS rank FROM {0}) WHERE rank <= {1}"


@register(f"WITH RECURSIVE {_SERIES}, {_DTW.format(source='t')} SELECT t.series_id, coalesce(e.distance, 'inf'::DOUBLE) AS distance FROM t LEFT JOIN e USING (series_id)")
def dtw_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _series_query(spark, sf_dir)
    return series(spark, sf_dir).mapInArrow(dtw.distances_of(query, BAND), "series_id long, distance double")


@register(f"WITH RECURSIVE {_SERIES}, {_DTW.format(source='t')} " + _RANKED.format("(SELECT * FROM e WHERE distance < 'inf'::DOUBLE)", K))
def dtw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dtw.topk(series(spark, sf_dir), _series_query(spark, sf_dir), K, BAND, 64)


@register(f"WITH {_SERIES} " + _RANKED.format(_PROXY, 20))
def dtw_proxy_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dtw.proxy_top(series(spark, sf_dir), _series_query(spark, sf_dir), 20)


@register(f"WITH RECURSIVE {_SERIES}, x AS (SELECT series_id, series FROM t JOIN ({_RANKED.format(_PROXY, 20)}) USING (series_id)), {_DTW.format(source='x')} " + _RANKED.format("(SELECT * FROM e WHERE distance < 'inf'::DOUBLE)", 5))
def dtw_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dtw.two_stage(series(spark, sf_dir), _series_query(spark, sf_dir), 5, BAND, 20)


# -- quantisation ----------------------------------------------------------------

PARTS = scalars.choose_subspaces(DIM)
SIZE = DIM // PARTS


def _book(spark: SparkSession, sf_dir: str) -> list[list[list[float]]]:
    """A fixed codebook: the parts of the 256 rows with the smallest ids."""
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(pq.CENTROIDS).select("embedding").collect()
    return [[[float(x) for x in r["embedding"][s * SIZE : (s + 1) * SIZE]] for r in rows] for s in range(PARTS)]


_BOOK = f"""k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS code, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {pq.CENTROIDS})),
w AS (SELECT s, code, v[s * {SIZE} + 1:(s + 1) * {SIZE}] AS p FROM k, range({PARTS}) r(s)),
x AS (SELECT vector_id, s, vector[s * {SIZE} + 1:(s + 1) * {SIZE}] AS p FROM c, range({PARTS}) r(s)),
y AS (SELECT vector_id, s, arg_min(code, [list_sum(list_transform(list_zip(x.p, w.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), code]) AS code FROM x JOIN w USING (s) GROUP BY vector_id, s),
codes AS (SELECT vector_id, list(code ORDER BY s) AS codes, flatten(list(w.p ORDER BY s)) AS decoded FROM y JOIN w USING (s, code) GROUP BY vector_id)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collection(spark, sf_dir).select("vector_id", "vector")
    book = _book(spark, sf_dir)
    return rows.withColumn("codes", pq.encoder(book)("vector")).join(F.broadcast(pq.book_frame(spark, book))).withColumn("decoded", pq.decode("codes", "book"))


@register(f"WITH {COLLECTION}, {_BOOK} SELECT vector_id, array_to_string(codes, ',') AS codes FROM codes")
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("vector_id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@register(f"WITH {COLLECTION}, {_BOOK} SELECT vector_id, list_sum(list_transform(list_zip(vector, decoded), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS error FROM codes JOIN c USING (vector_id)")
def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("vector_id", V.l2_squared("vector", "decoded").alias("error"))


_ADC = f"""{_BOOK}, f AS (SELECT vector_id, list_sum(list(list_sum(list_transform(list_zip(v[y.s * {SIZE} + 1:(y.s + 1) * {SIZE}], w.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) ORDER BY y.s)) AS far
  FROM y JOIN w USING (s, code), q GROUP BY vector_id)"""


@register(f"WITH {COLLECTION}, {_ADC} SELECT vector_id, far FROM f")
def pq_adc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = pq.adc_table(_book(spark, sf_dir), probe(spark, sf_dir))
    frame = spark.createDataFrame([(lookup,)], "adc array<array<double>>")
    return _codes(spark, sf_dir).join(F.broadcast(frame)).select("vector_id", pq.adc("codes", "adc").alias("far"))


@register(f"""WITH {COLLECTION}, {_ADC}, n AS (SELECT vector_id FROM f ORDER BY far, vector_id LIMIT {4 * K}), r AS (SELECT vector_id, list_inner_product(decoded, v) AS score FROM n JOIN codes USING (vector_id), q)
SELECT rank::INTEGER AS rank, vector_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vector_id) AS rank FROM r) WHERE rank <= {K}""")
def pq_topk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.archive_search(_codes(spark, sf_dir).select("vector_id", "codes"), _book(spark, sf_dir), probe(spark, sf_dir), K)


@register(f"""WITH {COLLECTION}, k AS (SELECT row_number() OVER (ORDER BY vector_id) - 1 AS code, vector AS p FROM (SELECT * FROM c ORDER BY vector_id LIMIT 8)),
a AS (SELECT c.vector_id, arg_min(code, [list_sum(list_transform(list_zip(c.vector, k.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), code]) AS cluster FROM c, k GROUP BY c.vector_id)
SELECT cluster::INTEGER AS cluster, count(*) AS members, round(avg(vector[1]), 9) AS c0, round(avg(vector[64]), 9) AS c63 FROM a JOIN c USING (vector_id) GROUP BY cluster""")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = [[float(x) for x in r["vector"]] for r in collection(spark, sf_dir).orderBy("vector_id").limit(8).collect()]
    return pq.kmeans_step(collection(spark, sf_dir), first).select("cluster", "members", F.round("c0", 9).alias("c0"), F.round("c63", 9).alias("c63"))


# -- pure functions --------------------------------------------------------------


@register("SELECT p_size AS dim, CASE " + " ".join(f"WHEN p_size % {n} = 0 THEN {n}" for n in scalars.SUBSPACES) + " ELSE 1 END AS subspaces FROM part")
def pq_choose_subspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("dim"), scalars.choose_subspaces_col("p_size").alias("subspaces"))


@register("SELECT p_partkey, greatest(10, ceil(greatest(p_size, 10, 1) / sqrt(greatest(p_partkey % 65, 1)::DOUBLE)))::BIGINT AS ef FROM part")
def hot_shard_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.shard_ef_col("p_size", F.lit(10), F.col("p_partkey") % 65).alias("ef"))


@register("""SELECT event_id, CASE WHEN event_id % 1000 > 850 THEN -1 WHEN event_id % 1000 > 700 THEN least(20, greatest(1, 1 + (event_id % 1000 - 700) * 19 // 150)) ELSE 0 END::BIGINT AS delay_ms FROM events""")
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.backpressure_ms(F.col("event_id") % 1000, 1000).alias("delay_ms"))


@register(f"WITH {COLLECTION} SELECT vector_id, greatest(0.35, least(1.0, 0.35::DOUBLE + 0.65::DOUBLE * list_inner_product(vector, v)))::DOUBLE AS gain FROM c, q")
def dsp_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir).select("vector_id", scalars.gain(V.dot("vector", V.vector(probe(spark, sf_dir)))).alias("gain"))


# -- audio framing ---------------------------------------------------------------


@register("SELECT doc_id, s AS start, s + 480 AS end FROM documents, unnest(range(0, n_chars - 479, 480)) r(s) WHERE n_chars >= 480 UNION ALL SELECT doc_id, 0, n_chars FROM documents WHERE n_chars BETWEEN 1 AND 479")
def frames_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lengths stand for sample counts."""
    ranges = audio.window_ranges("n_chars", 480, 480)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(ranges).alias("w")).select("doc_id", "w.start", "w.end")


@register("SELECT doc_id, s AS start, s + 960 AS end FROM documents, unnest(range(0, n_chars - 959, 480)) r(s) WHERE n_chars >= 960 UNION ALL SELECT doc_id, 0, n_chars FROM documents WHERE n_chars BETWEEN 1 AND 959")
def frames_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = audio.window_ranges("n_chars", 960, audio.hop_for(960))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(ranges).alias("w")).select("doc_id", "w.start", "w.end")


# -- without SQL -----------------------------------------------------------------


@register()
def pq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebooks trained on the collection: (subspace, centroids)."""
    return pq.train(collection(spark, sf_dir), DIM)


@register()
def ivf_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ann

    rows = collection(spark, sf_dir).select("vector_id", "vector")
    centroids = ann.fit_cells(rows, 16)
    queries = rows.filter("vector_id % 50 = 0").select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query"))
    return ann.ivf_batch(ann.assign_cells(rows, centroids), centroids, queries, K, probes=12)


@register()
def graph_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import ann

    rows = collection(spark, sf_dir).select("vector_id", "vector")
    return ann.graph_topk(rows, rows.filter("vector_id % 50 = 0").select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query")), K, ef=200)


@register()
def identify_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify.identify(collection(spark, sf_dir), sequence(spark, sf_dir), DIM, anchored=32)


@register()
def log_mel_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values repeated to a second of sound."""
    samples = F.flatten(F.array_repeat("series", 40))
    return audio.with_log_mel(series(spark, sf_dir).select("series_id", samples.alias("samples"))).select("series_id", F.size("log_mel").alias("mels"), F.size(F.get("log_mel", F.lit(0))).alias("frames"))


@register()
def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return audio.embedded(rows, "text", audio.hashing_encoder(32)).select("item_id", "vector")
