"""A collection on disk: immutable Parquet folders under numbered manifests, of which the highest is the current one.

The write-ahead log and the segments are Parquet folders; a manifest names those of
its version, so readers resolve it once and never see half a change.  A writer claims
the next number by creating a file that must not exist, and publishes by renaming a
finished file to the manifest's name; no file is ever replaced, so there is a current
version at any moment.  All files go through Hadoop's file system; it must create
files exclusively and rename them in one step (HDFS and mounted file systems do,
plain object stores don't).
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import Conflict, DimensionMismatch, InvalidTags, RequestError
from tessera.functions.tags import invalid_tags, tag_filter
from tessera.operators import identify as identify_runs
from tessera.operators import ingest, lifecycle, pq, search

WAL = T.StructType([
    T.StructField("lsn", T.LongType()), T.StructField("vector_id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("entity_id", T.LongType()), T.StructField("sequence_ts", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("payload", T.BinaryType()), T.StructField("idempotency_key", T.StringType()),
])
_ROWS = ["vector_id", "vector", "entity_id", "sequence_ts", "tags", "payload"]


class Store:
    """One collection.  Methods that change it publish a new manifest; a lost race raises Conflict."""

    def __init__(self, spark: SparkSession, folder: str, dim: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._version() is None:
            if dim is None:
                raise RequestError("a new collection needs a dimension")
            self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
            self._publish({"version": 0, "dim": dim, "next_id": 0, "next_lsn": 1, "wal": [], "checkpointed_lsn": 0, "segments": [], "next_segment": 1, "jobs": [], "audit": []})
        elif dim is not None and self.manifest()["dim"] != dim:
            raise Conflict(f"the collection has dimension {self.manifest()['dim']}, not {dim}")

    # -- manifest

    def _named(self, version: int) -> str:
        return f"{self.folder}/manifests/v{version:08d}.json"

    def _list(self, folder: str) -> list:
        """(name, age in seconds) of what is in a folder."""
        root = self._path(f"{self.folder}/{folder}")
        if not self._fs.exists(root):
            return []
        return [(f.getPath().getName(), time.time() - f.getModificationTime() / 1000) for f in self._fs.listStatus(root)]

    def _version(self) -> int | None:
        return max((int(name[1:-5]) for name, _ in self._list("manifests") if name.startswith("v") and name.endswith(".json")), default=None)

    def _text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def manifest(self) -> dict:
        return json.loads(self._text(self._named(self._version())))

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _publish(self, manifest: dict) -> None:
        """Of two writers of one version the second finds its number claimed; :meth:`recover` frees a claim whose writer is gone."""
        own = self._named(manifest["version"])
        claim = self._path(f"{self.folder}/manifests/{manifest['version']:08d}.claim")
        if self._fs.exists(self._path(own)) or not self._created(claim):
            raise Conflict(f"version {manifest['version']} is taken")
        temporary = f"{self.folder}/manifests/.{uuid.uuid4().hex}"
        self._put(temporary, json.dumps(manifest))
        if self._fs.exists(self._path(own)) or not self._fs.rename(self._path(temporary), self._path(own)):
            raise Conflict(f"version {manifest['version']} is taken")

    def _created(self, path) -> bool:
        try:
            return self._fs.createNewFile(path)
        except Py4JJavaError:  # some file systems raise where a file exists
            return False

    def _change(self, manifest: dict, job: str = "", **changes) -> dict:
        now = datetime.now(UTC).isoformat(timespec="seconds")
        new = manifest | changes | {"version": manifest["version"] + 1}
        if job:
            new["jobs"] = [*manifest["jobs"], {"kind": job, "state": "completed", "at": now}][-500:]
        new["audit"] = [*manifest["audit"], {"at": now, "action": job or "ingest", "version": new["version"], "rows": new["next_id"] - manifest["next_id"]}][-1000:]
        self._publish(new)
        return new

    def audit(self) -> DataFrame:
        """(at, action, version, rows) of the last thousand changes, rows being the ids that were given out."""
        return self.spark.createDataFrame([(a["at"], a["action"], a["version"], a["rows"]) for a in self.manifest()["audit"]], "at string, action string, version long, rows long")

    # -- tables

    def _wal(self, manifest: dict) -> DataFrame:
        paths = [f"{self.folder}/{p}" for p in manifest["wal"]]
        return self.spark.read.schema(WAL).parquet(*paths) if paths else self.spark.createDataFrame([], WAL)

    def wal(self) -> DataFrame:
        """The log with checkpointed_at (a segment's LSN bound) or null for pending rows."""
        m = self.manifest()
        return self._wal(m).withColumn("checkpointed_at", F.when(F.col("lsn") <= m["checkpointed_lsn"], F.lit(m["checkpointed_lsn"])))

    def vectors(self) -> DataFrame:
        """All rows with segment_id, level (null: hot) and pq; codes of quantised segments are decoded."""
        m = self.manifest()
        return self._rows(lambda s: self._segment(m, s))

    def _book(self, s: dict) -> list:
        return pq.book_of(self.spark.read.parquet(f"{self.folder}/{s['path']}-codebook").select("centroids", "subspace"))

    def _segment(self, m: dict, s: dict) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{s['path']}")
        if s["pq"]:
            rows = pq.decoded(rows, self._book(s))
        return self._labelled(rows, s)

    def _labelled(self, rows: DataFrame, s: dict) -> DataFrame:
        return rows.select(*_ROWS).withColumns({"segment_id": F.lit(s["segment_id"]).cast("long"), "level": F.lit(s["level"]).cast("int"), "pq": F.lit(s["pq"])})

    def _rows(self, of: Callable[[dict], DataFrame]) -> DataFrame:
        """The hot window's rows and, by ``of``, each active segment's."""
        m = self.manifest()
        hot = self._wal(m).filter(F.col("lsn") > m["checkpointed_lsn"]).select(*_ROWS)
        out = hot.withColumns({"segment_id": F.lit(None).cast("long"), "level": F.lit(None).cast("int"), "pq": F.lit(False)})
        for s in m["segments"]:
            if s["state"] == "active":
                out = out.unionByName(of(s))
        return out

    # -- requests

    def ingest(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> DataFrame | None:
        """Idempotent append of (ord, vector, ...); acks (ord, id, created).  One bad row rejects the batch before anything is written.

        ``stream``: a stream's name and its batch's number, published with the rows; a
        batch that is there already is not appended again, and gives None.
        """
        m = self.manifest()
        if stream and m.get("streams", {}).get(stream[0], -1) >= stream[1]:
            return None
        rows = ingest.with_defaults(batch)
        if "tags" in batch.columns and (bad := batch.select(invalid_tags("tags").alias("why")).filter("why is not null").first()):
            raise InvalidTags(bad["why"])
        wrong = rows.filter(~F.coalesce(F.size("vector") == m["dim"], F.lit(False))).select("ord", F.size("vector").alias("n")).orderBy("ord").first()
        if wrong:
            raise DimensionMismatch(f"dimension mismatch: expected {m['dim']}, got {wrong['n']} in row {wrong['ord']}")
        acks, new = ingest.append(self._wal(m).select("vector_id", "idempotency_key"), rows, m["next_id"])
        name = f"wal/{uuid.uuid4().hex}"
        shift = m["next_lsn"] - m["next_id"]
        new.withColumn("lsn", F.col("vector_id") + shift).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in WAL.fields)).write.parquet(f"{self.folder}/{name}")
        acks = ingest.checkpointed(acks)
        count = acks.filter("created").count()
        streams = m.get("streams", {}) | ({stream[0]: stream[1]} if stream else {})
        self._change(m, next_id=m["next_id"] + count, next_lsn=m["next_lsn"] + count, wal=[*m["wal"], name], streams=streams)
        return acks

    def query(self, vector: Sequence[float], k: int = 10, tags_all: Sequence[str] = (), tags_any: Sequence[str] = (), **options) -> DataFrame:
        """:func:`search.query`; of a quantised segment, the rows nearest by asymmetric distance alone are decoded and scored."""
        m = self.manifest()
        if len(vector) != m["dim"]:
            raise DimensionMismatch(f"dimension mismatch: expected {m['dim']}, got {len(vector)}")
        predicate = tag_filter("tags", tags_all, tags_any)

        def of(s: dict) -> DataFrame:
            if not s["pq"]:
                return self._segment(m, s)
            rows, book = self.spark.read.parquet(f"{self.folder}/{s['path']}"), self._book(s)
            rows = rows if predicate is None else rows.filter(predicate)
            return self._labelled(pq.decoded(pq.nearest_codes(rows, book, vector, k), book), s)

        return search.query(self._rows(of), vector, m["dim"], k, tags_all, tags_any, **options)

    def identify(self, sequence: Sequence[Sequence[float]], **options) -> DataFrame:
        return identify_runs.identify(self.vectors(), sequence, self.manifest()["dim"], **options)

    # -- lifecycle

    def _write_segment(self, m: dict, rows: DataFrame, level: int, lsn: int) -> dict:
        number = m["next_segment"]
        name = f"segments/{number:08d}-{uuid.uuid4().hex}"
        bounds = rows.agg(F.min("vector_id"), F.max("vector_id"), F.count("*")).first()
        coded = pq.quantised(bounds[2], level, m["dim"])
        if coded:
            book = pq.train(rows, m["dim"])
            book.write.parquet(f"{self.folder}/{name}-codebook")
            book = pq.book_of(self.spark.read.parquet(f"{self.folder}/{name}-codebook"))
            rows = rows.withColumn("codes", pq.encoder(book)("vector")).drop("vector").withColumn("vector", F.lit(None).cast("array<float>"))
        rows.sortWithinPartitions("vector_id").write.parquet(f"{self.folder}/{name}")
        return {"segment_id": number, "level": level, "state": "active", "path": name, "start_id": bounds[0], "end_id": bounds[1], "rows": bounds[2], "created_lsn": lsn, "pq": coded}

    def checkpoint(self, limit: int = lifecycle.CHECKPOINT_ROWS) -> dict | str:
        """Pending rows, the oldest ``limit``, as a segment of level 0; or why there is none."""
        m = self.manifest()
        rows = self._wal(m).filter((F.col("lsn") > m["checkpointed_lsn"]) & (F.col("lsn") <= m["checkpointed_lsn"] + limit)) if limit < 1 << 40 else self._wal(m)
        top = rows.agg(F.max("lsn")).first()[0]
        if top is None:
            return "no_pending_wal"
        segment = self._write_segment(m, lifecycle.densify(rows.select(*_ROWS)), 0, top)
        self._change(m, "checkpoint", checkpointed_lsn=top, segments=[*m["segments"], segment], next_segment=m["next_segment"] + 1)
        return segment

    def segments(self) -> DataFrame:
        schema = "segment_id long, level int, state string, path string, start_id long, end_id long, rows long, created_lsn long, pq boolean"
        return self.spark.createDataFrame([tuple(s[c.split()[0]] for c in schema.split(", ")) for s in self.manifest()["segments"]], schema)

    def compact(self) -> dict | str:
        """The next compaction, or why there is none."""
        m = self.manifest()
        plan = lifecycle.pick_compaction(self.segments(), self.wal().filter("checkpointed_at is null").count())
        if isinstance(plan, str):
            return plan
        own = [s for s in m["segments"] if s["segment_id"] in plan.inputs]
        rows = None
        for s in own:
            part = self._segment(m, s).select(*_ROWS).withColumn("segment_start", F.lit(s["start_id"]))
            rows = part if rows is None else rows.unionByName(part)
        merged = lifecycle.densify(lifecycle.newest_wins(rows).select(*_ROWS))
        segment = self._write_segment(m, merged, plan.level, max(s["created_lsn"] for s in own))
        kept = [s | {"state": "obsolete"} if s["segment_id"] in plan.inputs else s for s in m["segments"]]
        self._change(m, "compact", segments=[*kept, segment], next_segment=m["next_segment"] + 1)
        return segment

    def collect_garbage(self) -> int:
        """Delete the folders of segments that the manifest calls obsolete; returns how many.  What no manifest names yet is left alone."""
        m = self.manifest()
        gone = 0
        for s in m["segments"]:
            if s["state"] == "obsolete":
                for path in (s["path"], f"{s['path']}-codebook"):
                    gone += bool(self._fs.delete(self._path(f"{self.folder}/{path}"), True))
        self._change(m, "gc", segments=[s for s in m["segments"] if s["state"] != "obsolete"])
        return gone

    def recover(self, grace: float = 3600.0) -> dict[str, int]:
        """After a crash: everything that a writer left behind over ``grace`` seconds ago, in one call.

        Claims without a manifest are freed and unfinished manifests deleted; folders
        that the current manifest does not name go to quarantine; what is over its time
        or beyond the quarantine's caps is deleted.  Folders that the manifest names and
        that are gone raise.  Returns counts of each.
        """
        m = self.manifest()
        out = {"claims": 0, "unfinished": 0, "orphans": 0, "evicted": 0}
        for name, age in self._list("manifests"):
            stale = name.endswith(".claim") and int(name[:-6]) > m["version"]
            if age > grace and (stale or name.startswith(".") and not name.endswith(".crc")):
                out["claims" if stale else "unfinished"] += bool(self._fs.delete(self._path(f"{self.folder}/manifests/{name}"), False))
        named = {*m["wal"]} | {p for s in m["segments"] for p in (s["path"], f"{s['path']}-codebook")}
        lost = [p for p in self._living(m) if not self._fs.exists(self._path(f"{self.folder}/{p}"))]
        if lost:
            raise RequestError(f"the manifest names folders that are gone: {', '.join(lost[:5])}")
        quarantine = self._path(f"{self.folder}/quarantine")
        self._fs.mkdirs(quarantine)
        for kind in ("wal", "segments"):
            for name, age in self._list(kind):
                if f"{kind}/{name}" not in named and age > grace:
                    out["orphans"] += bool(self._fs.rename(self._path(f"{self.folder}/{kind}/{name}"), self._path(f"{self.folder}/quarantine/{int(time.time())}-{kind}-{name}")))
        held = [(name, int(name.split("-")[0]), self._fs.getContentSummary(self._path(f"{self.folder}/quarantine/{name}")).getLength()) for name, _ in self._list("quarantine")]
        if held:
            gone = lifecycle.evicted(self.spark.createDataFrame(held, "id string, quarantined_at long, bytes long"), int(time.time()))
            for row in gone.select("id").collect():  # the quarantine is capped
                out["evicted"] += bool(self._fs.delete(self._path(f"{self.folder}/quarantine/{row['id']}"), True))
        return out

    def _digest(self, paths: list[str]) -> dict[str, str]:
        if not paths:
            return {}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
        return {r["path"].rpartition("/")[2]: r["sha"] for r in files.select("path", F.sha2("content", 256).alias("sha")).collect()}

    def _living(self, m: dict) -> list[str]:
        own = [*m["wal"]]
        for s in m["segments"]:
            if s["state"] == "active":
                own += [s["path"]] + [f"{s['path']}-codebook"] * s["pq"]
        return own

    def snapshot(self, to: str) -> str:
        """A copy of the current version in ``to``, with a digest of every file."""
        m = self.manifest()
        living = self._living(m)
        digests = self._digest([f"{self.folder}/{p}" for p in living])
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in living:
            target = self._path(f"{to}/{p}")
            fs = target.getFileSystem(conf)
            fs.mkdirs(target.getParent())
            util.copy(self._fs, self._path(f"{self.folder}/{p}"), fs, target, False, conf)
        text = json.dumps({"manifest": m, "files": digests, "sha256": hashlib.sha256(json.dumps([m, digests], sort_keys=True).encode()).hexdigest()})
        self._put(f"{to}/SNAPSHOT", text)
        return to

    def restore(self, source: str) -> None:
        """The snapshot's state as a new version; its files are verified before anything changes."""
        text = json.loads(self._text(f"{source}/SNAPSHOT"))
        m, digests = text["manifest"], text["files"]
        if hashlib.sha256(json.dumps([m, digests], sort_keys=True).encode()).hexdigest() != text["sha256"]:
            raise RequestError("the snapshot's manifest does not match its digest")
        living = self._living(m)
        try:
            intact = self._digest([f"{source}/{p}" for p in living]) == digests
        except (Py4JJavaError, PySparkException) as e:  # the file system found a wrong block itself, or a file is gone
            raise RequestError("a file of the snapshot cannot be read") from e
        if not intact:
            raise RequestError("a file of the snapshot does not match its digest")
        now = self.manifest()
        util, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in living:
            target = self._path(f"{self.folder}/{p}")
            if not self._fs.exists(target):
                self._fs.mkdirs(target.getParent())
                util.copy(self._path(source).getFileSystem(conf), self._path(f"{source}/{p}"), self._fs, target, False, conf)
        self._publish(m | {"version": now["version"] + 1})

    def replay_to(self, lsn: int) -> None:
        """The state after log entry ``lsn``: what came later goes, and all that is left is pending again."""
        m = self.manifest()
        kept = self._wal(m).filter(F.col("lsn") <= lsn)
        name = f"wal/{uuid.uuid4().hex}"
        kept.write.parquet(f"{self.folder}/{name}")
        top = self.spark.read.schema(WAL).parquet(f"{self.folder}/{name}").agg(F.coalesce(F.max("vector_id"), F.lit(-1)), F.coalesce(F.max("lsn"), F.lit(0))).first()
        segments = [s | {"state": "obsolete"} if s["state"] == "active" else s for s in m["segments"]]
        self._change(m, "replay", wal=[name], checkpointed_lsn=0, segments=segments, next_id=top[0] + 1, next_lsn=top[1] + 1)
