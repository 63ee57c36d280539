"""The vector engine: registered queries against their SQL, and its invariants on the fixtures of FIXTURES.md."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.errors import Conflict, DimensionMismatch, InvalidTags, Overloaded, RequestError, SparseIds
from tessera.functions import scalars, tags
from tessera.functions import vectors as V
from tessera.operators import ann, dtw, identify, ingest, lifecycle, pq, search, stats
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as own:
        for p in glob.glob(f"{SF}/*.parquet"):
            own.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        yield own


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(clean, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        want = db.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.toPandas()) == rows(want)
    else:
        assert got.count() > 0


def frame(spark, table, schema="vector_id long, vector array<float>"):
    return spark.createDataFrame(table, schema)


def test_golden_filter(spark):
    made = [(i, [i / 100, 1 - i / 100], ["drums", "snare" if i % 2 == 0 else "kick"], i, 0, b"", None, False) for i in range(100)]
    df = frame(spark, made, "vector_id long, vector array<double>, tags array<string>, entity_id long, sequence_ts long, payload binary, level int, pq boolean")
    got = search.query(df, [0.42, 0.58], 2, 5, ["drums"], ["snare"]).orderBy("rank").collect()
    assert [r["vector_id"] for r in got] == [0, 2, 4, 6, 8] and all("snare" in r["tags"] for r in got)
    with pytest.raises(DimensionMismatch):
        search.query(df, [1.0], 2)
    with pytest.raises(RequestError):
        search.query(df, [1.0, 0.0], 2, tier="cold")
    assert search.query(df, [1.0, 0.0], 2, 0).collect() == []


def test_batch_forms_agree_and_pad(spark):
    rng = np.random.default_rng(0)
    table = frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))])
    queries = table.filter("vector_id < 7").select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query"))
    one, two = (f(table, queries, 5).orderBy("query_id", "rank").collect() for f in (search.batch_topk, search.batch_topk_blocks))
    assert [(r["query_id"], r["rank"], r["vector_id"]) for r in one] == [(r["query_id"], r["rank"], r["vector_id"]) for r in two]
    padded = search.batch_topk(table.limit(2), queries, 3, pad=True).filter("vector_id = -1").collect()
    assert len(padded) == 7 and all(r["score"] == float("-inf") for r in padded)


def test_identify_fixtures(spark):
    ids = 256
    archive = frame(spark, [(i, [math.sin(0.37 * i), math.cos(0.37 * i)], i, i * 20, i // 64, 2, False) for i in range(ids)], "vector_id long, vector array<double>, entity_id long, sequence_ts long, segment_id long, level int, pq boolean")
    sequence = [[math.sin(0.37 * i), math.cos(0.37 * i)] for i in range(140, 146)]
    got = identify.identify(archive, sequence, 2, 8).collect()
    assert 140 in {r["start_id"] for r in got}
    assert all(r["start_id"] // 64 == (r["start_id"] + 5) // 64 and r["duration_ms"] == 0 and r["start_timestamp_ms"] == r["start_id"] * 20 for r in got)
    anchored = identify.identify(archive, sequence, 2, 8, anchored=64).collect()
    assert 140 in {r["start_id"] for r in anchored}
    with pytest.raises(RequestError):
        identify.identify(archive, [], 2)
    with pytest.raises(DimensionMismatch):
        identify.identify(archive, [[1.0, 2.0, 3.0]], 2)
    assert identify.identify(archive, [[1.0]], 2, 0).collect() == []


def test_salient_anchors():
    loud = [[1.0]] * 60
    loud[5], loud[7], loud[55] = [9.0], [8.0], [7.0]
    assert identify.salient_anchors(loud) == [5, 55]
    assert identify.salient_anchors([[1.0], [3.0], [2.0], [3.0]]) == [1, 3, 2]
    assert identify.salient_anchors([]) == []


def test_dtw_fixtures(spark):
    a, b = np.array([1.0, 2, 3, 4]), np.array([2.0, 3, 4, 5])
    assert dtw.distance(a, b, 2) == 2.0 and dtw.distance(a, a, 0) == 0 and dtw.distance(a, a[:2], 1) == math.inf
    assert dtw.distance(a, b + 100, 2, 10.0) == math.inf
    series = spark.createDataFrame([(0, [2.0, 3.0, 4.0, 5.0]), (1, [1.0, 2.0, 3.0, 4.0]), (2, [0.5, 2.0, 3.5, 5.0])], "series_id long, series array<double>")
    assert [r["series_id"] for r in dtw.topk(series, [1.0, 2, 3, 4], 2, 2, 8).orderBy("rank").collect()][0] == 1
    inside = series.select("series_id", dtw.distance_col("series", V.vector([1.0, 2, 3, 4]), 2).alias("d")).collect()
    assert {r["series_id"]: r["d"] for r in inside} == {i: dtw.distance(a, np.array(s), 2) for i, s in [(0, [2.0, 3, 4, 5]), (1, [1.0, 2, 3, 4]), (2, [0.5, 2, 3.5, 5])]}
    with pytest.raises(RequestError):
        dtw.topk(series, [1.0], 2, 12, 8)
    with pytest.raises(RequestError):
        dtw.topk(series, [], 2, 1)
    assert dtw.topk(series, [1.0], 0, 1).collect() == []
    empty = spark.createDataFrame([(3, [])], series.schema)
    with pytest.raises(Exception, match="empty series"):
        dtw.topk(series.union(empty), [1.0, 2, 3, 4], 2, 2).collect()
    two = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 2.0, 3.0, 4.25]), (2, [0.0] * 4), (3, [10.0] * 4), (4, [])], series.schema)
    assert [r["series_id"] for r in dtw.two_stage(two, [1.0, 2, 3, 4], 2, 2, 2).orderBy("rank").collect()] == [0, 1]


def test_quantisation_properties(spark):
    rng = np.random.default_rng(42)
    centres = np.array([[0.0, 0], [5, 5], [10, 0]])
    points = np.concatenate([c + rng.normal(scale=0.3, size=(100, 2)) for c in centres])
    found = pq.lloyd(points, 3)
    assert sorted(map(tuple, found.round().tolist())) == [(0.0, 0.0), (5.0, 5.0), (10.0, 0.0)]
    with pytest.raises(RequestError):
        pq.lloyd(points[:2], 3)
    vectors = rng.normal(size=(400, 32))
    table = frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    book = pq.book_of(pq.train(table, 32, 4, k=64))
    assert len(book) == 4 and len(book[0]) == 64
    coded = table.join(F.broadcast(pq.book_frame(spark, book))).withColumn("codes", pq.encode("vector", "book", 4, 8)).drop("book").cache()
    for row in coded.limit(20).collect():
        for s, c in enumerate(row["codes"]):
            far = ((np.array(book[s]) - np.array(row["vector"][8 * s : 8 * s + 8])) ** 2).sum(axis=1)
            assert far[c] == pytest.approx(far.min())
    again = table.withColumn("codes", pq.encoder(book)("vector")).select("vector_id", "codes").collect()
    assert {r["vector_id"]: r["codes"] for r in again} == {r["vector_id"]: r["codes"] for r in coded.select("vector_id", "codes").collect()}
    best = pq.archive_search(coded, book, vectors[7].tolist(), 10).collect()
    assert 7 in {r["vector_id"] for r in best}
    assert pq.quantised(256, 2, 64) and not pq.quantised(255, 2, 64) and not pq.quantised(500, 1, 64) and not pq.quantised(500, 2, 7)


def test_approximate_search_recall(spark):
    rows_ = registry.collection(spark, "/root/testdata/sf0.1").select("vector_id", "vector").cache()
    queries = rows_.filter("vector_id % 50 = 0").select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query"))
    exact = search.batch_topk_blocks(rows_, queries, 10)
    centroids = ann.fit_cells(rows_, 16)
    index = ann.assign_cells(rows_, centroids)
    assert index.count() == rows_.count()
    assert ann.recall(ann.ivf_batch(index, centroids, queries, 10, probes=12), exact) >= 0.9
    assert ann.recall(ann.graph_topk(rows_, queries, 10, ef=200), exact) >= 0.9
    q = queries.first()["query"]
    assert [r["vector_id"] for r in ann.ivf_topk(index, centroids, q, 5, 16).orderBy("rank").collect()] == [r["vector_id"] for r in search.topk(rows_, q, 5).orderBy("rank").collect()]
    links = ann.graph_table(rows_.limit(300), shards=2)
    assert ann.graph_stats(links).orderBy("layer").first()["nodes"] == 300


def test_graph_filter_and_beams():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 16)).astype(np.float32)
    graph = ann.Graph(vectors)
    found = graph.search(vectors[3], 5, 100, lambda n: n % 2 == 1)
    assert found[0][0] == 3 and all(n % 2 for n, _ in found)
    assert ann.Graph(vectors[:0]).search(vectors[0], 3, 10) == []
    assert ann.beams(5000, 10**6, 50, 10) is None and ann.beams(50_000, 10**6, 50, 10) is None and ann.beams(600_000, 10**6, 50, 10) == [50, 100, 200, 400]


def test_filtered_search_falls_back():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 8)).astype(np.float32)
    graph = ann.Graph(vectors)
    few = set(range(0, 700, 50))
    want = sorted(few, key=lambda i: (-float(vectors[i] @ vectors[9]), i))[:5]
    assert [n for n, _ in ann.filtered_search(graph, vectors[9], 5, 20, few)] == want  # an exact scan
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ann, "SCAN", 0)
        patch.setattr(ann, "SCAN_SHARE", 0.0)
        found = ann.filtered_search(graph, vectors[9], 5, 20, few)
    assert len(found) == 5 and {n for n, _ in found} <= few


def test_plans_leave_the_collection_in_place(spark):
    rows_ = registry.collection(spark, SF)
    plan = search.query(rows_, [0.1] * registry.DIM, registry.DIM, 5, tier="all", include_metadata=False)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    queries = rows_.filter("vector_id < 5").select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query"))
    plan = search.batch_topk(rows_, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Broadcast" not in plan


def test_dtw_gives_up_only_what_is_too_far(spark):
    rng = np.random.default_rng(6)
    series = [(i, rng.normal(size=20).cumsum().tolist()) for i in range(200)]
    df = spark.createDataFrame(series, "series_id long, series array<double>")
    want = sorted((dtw.distance(np.array(series[3][1]), np.array(s), 4), i) for i, s in series)[:7]
    got = dtw.topk(df, series[3][1], 7, 4).orderBy("rank").collect()
    assert [(r["distance"], r["series_id"]) for r in got] == want


def test_newest_metadata_wins_where_segments_overlap(spark):
    made = [(1, [1.0, 0.0], ["old"], 0, 0), (1, [1.0, 0.0], ["new"], 1, 0), (2, [0.5, 0.0], ["seg"], 0, 0), (2, [0.4, 0.0], ["hot"], None, None)]
    df = frame(spark, [(i, v, t, i, 0, b"", s, lvl, False) for i, v, t, s, lvl in made], "vector_id long, vector array<double>, tags array<string>, entity_id long, sequence_ts long, payload binary, segment_id long, level int, pq boolean")
    got = {r["vector_id"]: (r["tags"], r["score"]) for r in search.query(df, [1.0, 0.0], 2, 5, tier="all").collect()}
    assert got == {1: (["new"], 1.0), 2: (["hot"], 0.5)}


def test_idempotent_batches(spark):
    schema = "ord long, vector array<float>, payload binary, idempotency_key string"
    one = spark.createDataFrame([(0, [1.0, 0.0], b"a", "k1"), (1, [0.0, 1.0], b"b", " k2 "), (2, [9.0, 9.0], b"c", "k1"), (3, [1.0, 1.0], b"d", None)], schema)
    nothing = spark.createDataFrame([], "vector_id long, idempotency_key string")
    acks, new = ingest.append(nothing, one)
    assert [(r["id"], r["created"]) for r in acks.orderBy("ord").collect()] == [(0, True), (1, True), (0, False), (2, True)]
    two = spark.createDataFrame([(0, [0.0, 0.0], b"z", "k2"), (1, [0.5, 0.5], b"e", "k3")], schema)
    acks, more = ingest.append(new.select("vector_id", "idempotency_key"), two)
    assert [(r["id"], r["created"]) for r in acks.orderBy("ord").collect()] == [(1, False), (3, True)]
    assert ingest.counter(more) == 4 and ingest.counter(more, 9) == 9
    with pytest.raises(Conflict):
        ingest.check_unique(more.union(more), "vector_id")


def test_dense_numbers_over_many_partitions(spark):
    numbered = ingest.dense_numbers(spark.range(0, 5000, 1, 13).withColumn("x", F.xxhash64("id")), ["x"], "n", 100)
    got = numbered.orderBy("n").select("n", "x").collect()
    assert [r["n"] for r in got] == list(range(100, 5100)) and [r["x"] for r in got] == sorted(r["x"] for r in got)


def test_gaps_and_repeats(spark):
    def check(ids):
        lifecycle.densify(spark.createDataFrame([(i,) for i in ids], "vector_id long"))

    check(range(65_530, 65_545))
    with pytest.raises(SparseIds, match="gap"):
        check([1, 2, 4])
    with pytest.raises(SparseIds, match="duplicate"):
        check([1, 2, 2])
    with pytest.raises(SparseIds):
        check([65_535, 65_537])


def test_tags(spark):
    df = spark.createDataFrame([(10, ["drums", "snare"]), (11, ["drums"]), (12, ["bass"])], "vector_id long, tags array<string>")
    hit = lambda a, b: {r["vector_id"] for r in df.filter(tags.tag_filter("tags", a, b)).collect()}
    assert hit(["drums"], ["drums", "bass"]) == {10, 11}
    sparse = spark.createDataFrame([(i, [t]) for i in (0, 1, 65_537, 131_073) for t in ("a", "b") if t == "a" or i], "vector_id long, tags array<string>")
    maps = tags.bitmaps(sparse)
    assert tags.bitmap_cardinality(tags.bitmap_union(maps, ["a", "b"])).first()[0] == 4
    assert tags.bitmap_cardinality(tags.bitmap_intersection(maps, ["a", "b"])).first()[0] == 3
    bad = spark.createDataFrame([(["x"] * 65,), (["y" * 65],), (["a b"],), (["ok-1_./:", " "],), (None,)], "tags array<string>")
    assert [r[0] for r in bad.select(tags.invalid_tags("tags")).collect()] == ["too many tags", "tag too long", "invalid characters", None, None]
    with pytest.raises(Overloaded):
        tags.allocate_tag_ids(spark.createDataFrame([(1, "a")], "tag_id long, tag string"), spark.createDataFrame([("b",)], "tag string"), most=1)


def test_scalar_functions(spark):
    assert [scalars.choose_subspaces(d) for d in (64, 20, 7, 9)] == [16, 10, 1, 3]
    assert scalars.shard_ef(50, 10, 64) == 10 and scalars.shard_ef(100, 10, 1) == 100
    assert scalars.allows("admin", "query") and not scalars.allows("query", "ingest") and scalars.roles_of(" Admin, x,query") == ["admin", "query"]
    assert scalars.bearer("Bearer key.secret") == ("key", "secret") and scalars.bearer("Basic x.y") is None and scalars.bearer(None) is None
    assert scalars.same_secret(scalars.token_hash("a"), scalars.token_hash("a"))
    row = spark.range(1).select(scalars.mel_to_hz(scalars.hz_to_mel(F.lit(440.0))).alias("hz"), scalars.layer_of(F.lit(0.001), 16).alias("layer"), scalars.crossfade(F.lit(5), 10).alias("x")).first()
    assert row["hz"] == pytest.approx(440) and row["layer"] == 2 and row["x"] == 0.5


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 10, 11, 99, 5000)], "us double")
    got = {r["le"]: r["count"] for r in stats.latency_histogram(df, "us").collect()}
    assert list(got.values()) == sorted(got.values()) and got["+Inf"] == 5 and got["10"] == 2
    metrics = spark.createDataFrame([("rows", {"tier": "hot"}, 3), ("up", {}, 1)], "name string, labels map<string,string>, value long")
    assert [r[0] for r in stats.prometheus(metrics).collect()] == ['rows{tier="hot"} 3', "up 1"]


def test_compaction_choice(spark):
    schema = "segment_id long, level int, state string, start_id long"
    some = spark.createDataFrame([(i, 0, "active", 10 * i) for i in range(10)] + [(20, 1, "active", 0)], schema)
    assert lifecycle.pick_compaction(some) == lifecycle.Plan(tuple(range(8)), 1)
    assert lifecycle.pick_compaction(some, 5000) == "wal_backlog"
    assert lifecycle.pick_compaction(some.filter("level = 1")) == "too_few_segments"
