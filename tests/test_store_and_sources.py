"""Store lifecycle, streaming ingest, vector files and audio."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import Conflict, DimensionMismatch, InvalidTags, RequestError
from tessera.functions import numbers_io
from tessera.operators import audio
from tessera.plans.store import Store
from tessera.sources import vdb
from tessera.sources.datasource import VdbSource
from tessera.streaming.ingest import chunk_numbers, stream_into, windowed_counts

BATCH = "ord long, vector array<float>, tags array<string>, payload binary, idempotency_key string"


def batch(spark, n, start=0, prefix="k"):
    return spark.createDataFrame([(i, [math.sin(0.37 * (start + i)), math.cos(0.37 * (start + i))], ["Archive", "pq"], b"p", f"{prefix}{start + i}") for i in range(n)], BATCH)


def test_store_lifecycle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    assert store.checkpoint() == "no_pending_wal"
    for part in range(4):
        acks = store.ingest(batch(spark, 64, 64 * part))
        assert acks.filter("created").count() == 64
        assert store.checkpoint()["rows"] == 64
    assert {r["created"] for r in store.ingest(batch(spark, 5)).collect()} == {False}
    want = [r["vector_id"] for r in store.query([0.6, 0.8], k=5, tier="all").orderBy("rank").collect()]
    assert store.compact()["level"] == 1
    assert [r["vector_id"] for r in store.query([0.6, 0.8], k=5, tier="all").orderBy("rank").collect()] == want
    assert store.compact() == "too_few_segments"
    for part in range(4, 6):
        store.ingest(batch(spark, 64, 64 * part))
        store.checkpoint()
    assert store.compact()["level"] == 1
    top = store.compact()
    assert top["level"] == 2 and top["pq"] and top["rows"] == 384
    assert store.query([0.6, 0.8], k=3, tags_any=["PQ "], tier="archive").count() == 3
    sequence = [[math.sin(0.37 * i), math.cos(0.37 * i)] for i in range(140, 146)]
    assert store.identify(sequence, k=40, tier="archive").filter("score > 0.95").count() > 0
    assert store.vectors().count() == 384 and store.vectors().select("vector_id").distinct().count() == 384
    assert store.collect_garbage() >= 6
    with pytest.raises(Conflict):
        Store(spark, str(tmp_path / "store"), 3)
    with pytest.raises(DimensionMismatch):
        store.ingest(spark.createDataFrame([(0, [1.0], [], b"", None)], BATCH))
    with pytest.raises(InvalidTags):
        store.ingest(spark.createDataFrame([(0, [1.0, 2.0], ["b ad"], b"", None)], BATCH))


def test_snapshot_restore_replay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    store.ingest(batch(spark, 30))
    saved = store.snapshot(str(tmp_path / "saved"))
    store.ingest(batch(spark, 10, 30))
    assert store.vectors().count() == 40
    store.restore(saved)
    assert store.vectors().count() == 30 and store.manifest()["next_id"] == 30
    store.checkpoint()
    store.replay_to(10)
    assert store.vectors().count() == 10 and store.vectors().agg(F.max("vector_id")).first()[0] == 9
    assert store.ingest(batch(spark, 1, 99)).first()["id"] == 10
    part = next((tmp_path / "saved").rglob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"X")
    with pytest.raises(RequestError):
        store.restore(saved)
    with pytest.raises(RequestError):
        Store(spark, str(tmp_path / "new"))


def test_every_step_of_publishing_may_be_the_last(spark, tmp_path, monkeypatch):
    """A writer that dies between any two steps leaves the version before it readable; recovery lets others go on."""
    store = Store(spark, str(tmp_path / "store"), 2)
    store.ingest(batch(spark, 10))

    class Died(Exception):
        pass

    def die(*_, **__):
        raise Died

    steps = [("_publish", "before the claim"), ("_put", "after the claim")]
    for step, _ in steps:
        with monkeypatch.context() as patch:
            patch.setattr(store, step, die)
            with pytest.raises(Died):
                store.checkpoint()
        assert Store(spark, store.folder, 2).vectors().count() == 10 and store.manifest()["segments"] == []
    (tmp_path / "store/manifests/.half").write_text("{")
    with pytest.raises(Conflict):  # the claim stands
        store.checkpoint()
    assert store.recover() == {"claims": 0, "unfinished": 0, "orphans": 0, "evicted": 0}  # nothing is old enough
    assert store.collect_garbage is not None and len(list((tmp_path / "store/segments").iterdir())) == 3
    done = store.recover(grace=-1)
    assert done["claims"] == 1 and done["unfinished"] >= 1 and done["orphans"] == 3
    assert store.checkpoint()["rows"] == 10 and store.vectors().count() == 10
    assert [r["action"] for r in store.audit().orderBy("version").collect()] == ["ingest", "checkpoint"]
    other = Store(spark, store.folder)
    stale = store.manifest()
    other.ingest(batch(spark, 1, 50))
    with pytest.raises(Conflict):
        store._change(stale, "late")


def test_garbage_spares_what_is_not_published(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    store.ingest(batch(spark, 5))
    store.checkpoint()
    (tmp_path / "store/segments/00000009-new").mkdir()
    assert store.collect_garbage() == 0 and (tmp_path / "store/segments/00000009-new").exists()
    import shutil

    shutil.rmtree(tmp_path / "store" / store.manifest()["segments"][0]["path"])
    with pytest.raises(RequestError):
        store.recover()


def test_archive_rows_are_preselected_by_codes(spark, tmp_path):
    from tessera.operators import pq

    store = Store(spark, str(tmp_path / "store"), 2)
    store.ingest(batch(spark, 600))
    m = store.manifest()
    segment = store._write_segment(m, store.vectors(), 2, 600)
    assert segment["pq"]
    store._change(m, "checkpoint", checkpointed_lsn=600, segments=[segment], next_segment=2)
    book = store._book(segment)
    rows = spark.read.parquet(f"{store.folder}/{segment['path']}")
    for query, k in (([0.6, 0.8], 3), ([-1.0, 0.1], 5)):
        want = [(r["rank"], r["vector_id"], r["score"]) for r in pq.archive_search(rows, book, query, k).orderBy("rank").collect()]
        got = [(r["rank"], r["vector_id"], r["score"]) for r in store.query(query, k, tier="archive", include_metadata=False).orderBy("rank").collect()]
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_json_lists(spark, tmp_path):
    from tessera.sources.lists import read_json_vectors

    (tmp_path / "a.json").write_text("[[1, 2.5],\n [3, 4]]")
    (tmp_path / "b.json").write_text("[]")
    assert [(r["vector_id"], r["vector"]) for r in read_json_vectors(spark, str(tmp_path)).orderBy("vector_id").collect()] == [(0, [1.0, 2.5]), (1, [3.0, 4.0])]
    (tmp_path / "c.json").write_text("[[1, 2")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_json_vectors(spark, str(tmp_path / "c.json")).collect()


def test_streaming_ingest(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = batch(spark, 20).drop("ord").unionByName(batch(spark, 5).drop("ord"))
    rows.write.parquet(source)
    store = Store(spark, str(tmp_path / "store"), 2)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    stream_into(stream, store, str(tmp_path / "state")).awaitTermination(120)
    assert store.vectors().count() == 20
    batch(spark, 8, 15).drop("ord").write.mode("append").parquet(source)
    stream_into(spark.readStream.schema(rows.schema).parquet(source), store, str(tmp_path / "state")).awaitTermination(120)
    assert store.vectors().count() == 23 and store.vectors().agg(F.max("vector_id")).first()[0] == 22


def test_a_replayed_batch_without_keys_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    rows = batch(spark, 4).withColumn("idempotency_key", F.lit(None).cast("string"))
    assert store.ingest(rows, ("s", 0)).count() == 4
    assert store.ingest(rows, ("s", 0)) is None and store.vectors().count() == 4
    assert store.ingest(rows, ("s", 1)).count() == 4 and store.vectors().count() == 8


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "ts", "1 hour").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("rows")).first()[0] == events.count()


def test_chunks(spark):
    df = spark.range(100).withColumn("size", F.lit(10))
    chunks = chunk_numbers(df, "id", "size", 30, 150).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()
    assert all(r["n"] <= 30 and r["s"] <= 150 for r in chunks) and sum(r["n"] for r in chunks) == 100


def test_vector_files(spark, tmp_path):
    table = np.random.default_rng(1).normal(size=(50, 6)).astype(np.float32)
    meta = [{"source_file": f"é{i}.wav", "start_time_ms": i, "duration_ms": 5, "bpm": 1.5, "tags": ["a", "b"]} for i in range(50)]
    graph = vdb.pack_graph([(0, [[1], [1]]), (1, [[0], [0]])], 0)
    for version in (1, 2):
        raw = vdb.pack(table, version, meta if version == 2 else None, graph if version == 2 else b"")
        header, back, got, book = vdb.unpack(raw)
        assert vdb.detect(raw) == version and (back == table).all() and book is None and header.count == 50
        assert got == (meta if version == 2 else [])
        (tmp_path / f"v{version}.vdb").write_bytes(raw)
        with pytest.raises(vdb.FormatError):
            vdb.unpack(raw[:100])
    assert vdb.unpack_graph(raw[header.graph_at :]) == ([(0, [[1], [1]]), (1, [[0], [0]])], 0)
    with pytest.raises(vdb.FormatError):
        vdb.unpack_graph(graph[:-2])
    for bad in (b"", b"VIBDB001", b"x" * 80, vdb.Header(2, 1, 1, vectors_at=65).pack()):
        with pytest.raises(vdb.FormatError):
            vdb.read_header(bad)
    rows = vdb.read(spark, str(tmp_path / "v2.vdb")).orderBy("vector_id").collect()
    assert rows[3]["vector"] == table[3].tolist() and rows[3]["source_file"] == "é3.wav" and rows[3]["tags"] == ["a", "b"]
    assert {(r["version"], r["count"], r["dim"]) for r in vdb.headers(spark, str(tmp_path / "*.vdb")).collect()} == {(1, 50, 6), (2, 50, 6)}
    assert vdb.is_empty({}) and not vdb.is_empty(meta[0])


def test_quantised_file(spark, tmp_path):
    book = np.random.default_rng(2).normal(size=(2, 256, 3)).astype(np.float32)
    codes = [[1, 255], [0, 7]]
    (tmp_path / "pq.vdb").write_bytes(vdb.pack(codes, 2, [{"source_file": "x"}, {}], codebook=book))
    header, back, meta, got = vdb.unpack((tmp_path / "pq.vdb").read_bytes())
    assert back.tolist() == codes and (got == book).all() and header.dim == 6 and meta[0]["source_file"] == "x"
    assert [r["codes"] for r in vdb.read_codes(spark, str(tmp_path / "pq.vdb")).orderBy("vector_id").collect()] == codes
    with pytest.raises(Exception, match="no raw vectors"):
        vdb.read(spark, str(tmp_path / "pq.vdb")).collect()


def test_data_source_splits_by_rows(spark, tmp_path):
    spark.dataSource.register(VdbSource)
    rows = spark.range(1000).select(F.col("id").alias("vector_id"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vector"), F.concat(F.lit("f"), "id").alias("source_file"))
    for version in (1, 2):
        folder = str(tmp_path / f"v{version}")
        vdb.write(rows, folder, version, files=3)
        back = spark.read.format("vdb").option("path", folder).option("rows_per_split", 100).load()
        assert back.rdd.getNumPartitions() >= 10 and back.count() == 1000
        assert back.select(F.get("vector", F.lit(0)).alias("x")).distinct().count() == 1000
    vdb.merge(spark, str(tmp_path / "v2"), rows.limit(5), str(tmp_path / "merged"))
    assert vdb.read(spark, str(tmp_path / "merged")).count() >= 1000


def test_blobs(spark):
    assert numbers_io.blob_to_floats(numbers_io.floats_to_blob([1.5, -2.0])) == [1.5, -2.0]
    assert numbers_io.blob_to_ids(numbers_io.ids_to_blob([3, 1, 3])) == [1, 3]
    with pytest.raises(ValueError):
        numbers_io.blob_to_floats(b"123")
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(numbers_io.blob_vector(numbers_io.vector_blob("v"))).collect()] == [[1.0, 2.0], None]


def wav(samples, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.repeat(samples, channels) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio(spark, tmp_path):
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.WAV").write_bytes(wav(tone, channels=2))
    (tmp_path / "b.wav").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(b"no sound")
    rows = audio.read(spark, str(tmp_path))
    got = {r["path"].rpartition("/")[2]: r for r in rows.collect()}
    assert set(got) == {"a.WAV", "b.wav"} and got["b.wav"]["error"] and np.allclose(got["a.WAV"]["samples"], tone, atol=1e-3)
    up = audio.resampled(rows.filter("error is null"), 16_000).first()
    assert len(up["samples"]) == 16_000
    spectrum = np.abs(np.fft.rfft(up["samples"]))
    assert abs(int(spectrum.argmax()) - 440) <= 1
    pieces = audio.frames(rows.filter("error is null"), 3000, 1500).collect()
    assert [r["start"] for r in pieces] == [0, 1500, 3000, 4500] and all(len(r["samples"]) == 3000 for r in pieces)
    mel = audio.log_mel(np.asarray(up["samples"]), 16_000)
    assert mel.shape[0] == 64 and np.isfinite(mel).all() and audio.log_mel(np.zeros(0)).shape == (64, 0)
    assert audio.log_mel_db(np.asarray(up["samples"])).max() == 0
    vectors = audio.embedded(rows.filter("error is null"), "samples", audio.hashing_encoder(16)).first()["vector"]
    assert np.linalg.norm(vectors) == pytest.approx(1, abs=1e-5)


def test_transient_windows():
    quiet = np.zeros((100, 4))
    assert audio.transient_ranges(1000, 200, quiet, 10) == [(s, s + 200) for s in range(0, 801, 100)]
    loud = quiet.copy()
    loud[39] = 5
    moved = audio.transient_ranges(1000, 200, loud, 10)
    assert (200, 410) in moved and audio.transient_ranges(0, 200, quiet, 10) == []
    assert audio.transient_ranges(50, 200, quiet[:5], 10) == [(0, 50)]
