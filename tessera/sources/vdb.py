"""Vector files: flat (version 1) and sectioned (version 2) layouts.

Codecs of whole files, and readers over any file system that Spark knows.  For large
files on a mounted file system, :mod:`tessera.sources.datasource` splits by rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: magics, header sizes, flags, alignment, and the metadata entry
# (file offset u32, file length u16, start u32, duration u16, bpm f32, tags offset u32, tags length u16, reserved u16).
MAGIC_1, MAGIC_2, MAGIC_GRAPH = b"VIBDB001", b"VIBDB002", b"VIBGRAPH"
HEADER_1, HEADER_2, ALIGN = 16, 64, 64
PQ, METADATA, GRAPH = 1, 2, 4
_ENTRY = struct.Struct("<IHIHfIHH")
_V2 = struct.Struct("<8sIIIIIQQQQ4x")


class FormatError(ValueError):
    """A file that breaks its format."""


@dataclass(frozen=True)
class Header:
    version: int
    count: int
    dim: int
    flags: int = 0
    subspaces: int = 0
    vectors_at: int = HEADER_1
    codebook_at: int = 0
    metadata_at: int = 0
    graph_at: int = 0

    def pack(self) -> bytes:
        if self.version == 1:
            return struct.pack("<8sII", MAGIC_1, self.count, self.dim)
        return _V2.pack(MAGIC_2, 2, self.flags, self.count, self.dim, self.subspaces, self.vectors_at, self.codebook_at, self.metadata_at, self.graph_at)


def detect(raw: bytes) -> int | None:
    """Format version by the first bytes, None if neither."""
    return {MAGIC_1: 1, MAGIC_2: 2}.get(bytes(raw[:8]))


def read_header(raw: bytes) -> Header:
    version = detect(raw)
    if version == 1:
        if len(raw) < HEADER_1:
            raise FormatError("file too small for its header")
        count, dim = struct.unpack_from("<II", raw, 8)
        return Header(1, count, dim)
    if version != 2:
        raise FormatError("unknown magic")
    if len(raw) < HEADER_2:
        raise FormatError("file too small for its header")
    _, number, flags, count, dim, subspaces, vectors, codebook, metadata, graph = _V2.unpack_from(raw)
    if number != 2:
        raise FormatError(f"unsupported version {number}")
    if vectors % ALIGN:
        raise FormatError(f"vectors section misaligned at {vectors}")
    return Header(2, count, dim, flags, subspaces, vectors, codebook, metadata, graph)


def check_size(header: Header, size: int) -> None:
    row = header.subspaces if header.flags & PQ else 4 * header.dim
    if header.vectors_at + header.count * row > size:
        raise FormatError(f"{size} bytes are too few for {header.count} rows")


def pack_metadata(rows: Sequence[dict]) -> bytes:
    """Entries and string pool of (source_file, start_time_ms, duration_ms, bpm, tags); texts are cut at 65,535 bytes."""
    pool, entries = bytearray(), []

    def put(text: str) -> tuple[int, int]:
        raw = text.encode()[:65_535]
        at = len(pool)
        pool.extend(raw)
        return at, len(raw)

    for r in rows:
        file, tags = put(r.get("source_file") or ""), put(",".join(r.get("tags") or ()))
        entries.append(_ENTRY.pack(*file, r.get("start_time_ms") or 0, r.get("duration_ms") or 0, r.get("bpm") or 0.0, *tags, 0))
    return struct.pack("<II", len(entries), 8 + _ENTRY.size * len(entries)) + b"".join(entries) + bytes(pool)


def unpack_metadata(raw: bytes) -> list[dict]:
    if len(raw) < 8:
        raise FormatError("metadata section too small")
    count, pool = struct.unpack_from("<II", raw)
    if pool < 8 + count * _ENTRY.size or pool > len(raw):
        raise FormatError("metadata string pool out of bounds")

    def text(at: int, size: int) -> str:
        if pool + at + size > len(raw):
            raise FormatError("metadata text out of bounds")
        return raw[pool + at : pool + at + size].decode("utf-8", "replace")

    out = []
    for i in range(count):
        file_at, file_n, start, duration, bpm, tags_at, tags_n, _ = _ENTRY.unpack_from(raw, 8 + i * _ENTRY.size)
        tags = text(tags_at, tags_n)
        out.append({"source_file": text(file_at, file_n), "start_time_ms": start, "duration_ms": duration, "bpm": bpm, "tags": tags.split(",") if tags else []})
    return out


def is_empty(meta: dict | None) -> bool:
    """Whether all fields have their defaults."""
    return not meta or not any(meta.get(k) for k in ("source_file", "start_time_ms", "duration_ms", "bpm", "tags"))


def pack_graph(nodes: Sequence[tuple[int, Sequence[Sequence[int]]]], entry: int | None, m: int = 16, m0: int = 32, ef: int = 100) -> bytes:
    """A graph section: (node id, neighbour lists by layer) and the entry point."""
    top = max((len(layers) - 1 for _, layers in nodes), default=0)
    out = [MAGIC_GRAPH, struct.pack("<IIBIII", len(nodes), 0xFFFFFFFF if entry is None else entry, top, m, m0, ef)]
    for node, layers in nodes:
        out.append(struct.pack("<IB", node, max(len(layers) - 1, 0)))
        out += [struct.pack(f"<I{len(own)}I", len(own), *own) for own in layers]
    return b"".join(out)


def unpack_graph(raw: bytes) -> tuple[list[tuple[int, list[list[int]]]], int | None]:
    if raw[:8] != MAGIC_GRAPH:
        raise FormatError("no graph section")
    try:
        count, entry, _, _, _, _ = struct.unpack_from("<IIBIII", raw, 8)
        at, nodes = 8 + 21, []
        for _ in range(count):
            node, top = struct.unpack_from("<IB", raw, at)
            at, layers = at + 5, []
            for _ in range(top + 1):
                (n,) = struct.unpack_from("<I", raw, at)
                layers.append(list(struct.unpack_from(f"<{n}I", raw, at + 4)))
                at += 4 + 4 * n
            nodes.append((node, layers))
    except struct.error as e:
        raise FormatError("graph section is cut off") from e
    return nodes, None if entry == 0xFFFFFFFF else entry


def invalid_links(graph: DataFrame, n: int) -> DataFrame:
    """(node_id, layer, neighbor) links of a graph table (node_id, layer, neighbors) that leave 0..n-1."""
    links = graph.select("node_id", "layer", F.explode_outer("neighbors").alias("neighbor"))
    return links.filter((F.col("node_id") < 0) | (F.col("node_id") >= n) | (F.col("neighbor") < 0) | (F.col("neighbor") >= n))


def pack(vectors, version: int = 1, metadata: Sequence[dict] | None = None, graph: bytes = b"", codebook=None) -> bytes:
    """A whole file.  With ``codebook`` ([subspace][256][size] floats) ``vectors`` are codes, and the file is version 2."""
    if codebook is not None:
        book, codes = np.asarray(codebook, dtype="<f4"), np.asarray(vectors, dtype=np.uint8)
        body, dim, subspaces, flags, tail = codes.tobytes(), book.shape[0] * book.shape[2], book.shape[0], PQ, book.tobytes()
        count = len(codes)
    else:
        table = np.asarray(vectors, dtype="<f4")
        if table.size == 0:
            table = table.reshape(0, 0)
        body, (count, dim), subspaces, flags, tail = table.tobytes(), table.shape, 0, 0, b""
    if version == 1 and codebook is None:
        return Header(1, count, dim).pack() + body
    codebook_at = HEADER_2 + len(body) if tail else 0
    at = HEADER_2 + len(body) + len(tail)
    meta = pack_metadata(metadata) if metadata else b""
    if metadata and len(metadata) != count:
        raise FormatError(f"{len(metadata)} metadata rows for {count} vectors")
    header = Header(2, count, dim, flags | METADATA * bool(meta) | GRAPH * bool(graph), subspaces, HEADER_2, codebook_at, at if meta else 0, at + len(meta) if graph else 0)
    return header.pack() + body + tail + meta + graph


def unpack(raw: bytes) -> tuple[Header, np.ndarray, list[dict], np.ndarray | None]:
    """(header, vectors or codes, metadata, codebook) of a whole file; every section is bounds-checked."""
    header = read_header(raw)
    check_size(header, len(raw))
    if header.flags & PQ:
        if not header.subspaces or header.dim % header.subspaces:
            raise FormatError(f"{header.subspaces} subspaces do not divide {header.dim}")
        table = np.frombuffer(raw, np.uint8, header.count * header.subspaces, header.vectors_at).reshape(header.count, header.subspaces)
        size = header.dim // header.subspaces
        if header.codebook_at + 4 * 256 * header.dim > len(raw):
            raise FormatError("codebook out of bounds")
        book = np.frombuffer(raw, "<f4", 256 * header.dim, header.codebook_at).reshape(header.subspaces, 256, size)
    else:
        table, book = np.frombuffer(raw, "<f4", header.count * header.dim, header.vectors_at).reshape(header.count, header.dim), None
    meta: list[dict] = []
    if header.flags & METADATA:
        if not HEADER_2 <= header.metadata_at <= len(raw):
            raise FormatError("metadata section out of bounds")
        end = header.graph_at if header.flags & GRAPH and header.graph_at > header.metadata_at else len(raw)
        meta = unpack_metadata(raw[header.metadata_at : end])
    return header, table, meta, book


_ROWS = "vector_id long, vector array<float>, source_file string, start_time_ms long, duration_ms int, bpm float, tags array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            header, table, meta, _ = unpack(content.as_py())
            if header.flags & PQ:
                raise FormatError("codes have no raw vectors; read them with read_codes")
            for lo in range(0, header.count, 4096):
                hi = min(header.count, lo + 4096)
                own = meta[lo:hi] if meta else [{}] * (hi - lo)
                field = lambda name, kind: pa.array([m.get(name) for m in own], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * header.dim, header.dim, dtype=np.int32) if header.dim else np.zeros(hi - lo + 1, dtype=np.int32)), pa.array(table[lo:hi].ravel().astype(np.float32))),
                     field("source_file", pa.string()), field("start_time_ms", pa.int64()), field("duration_ms", pa.int32()), field("bpm", pa.float32()), field("tags", pa.list_(pa.string()))],
                    names=[c.split()[0] for c in _ROWS.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """vector_id (place in its file), vector and legacy metadata (null without a section) of the files in ``path``, both versions."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, _ROWS)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, version, count and dim of each file; null for other files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, n, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "head")), strict=True):
                h = read_header(raw) if detect(raw) else None
                out.append((p, n, h and h.version, h and h.count, h and h.dim))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["path", "bytes", "version", "count", "dim"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.substring("content", 1, HEADER_2).alias("head")).mapInArrow(run, "path string, bytes long, version int, count long, dim long")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """vector_id and codes of quantised files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                header, table, _, book = unpack(content.as_py())
                if book is None:
                    raise FormatError("no codes in this file")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(header.count)), pa.array([r.tolist() for r in table], pa.list_(pa.int32()))], names=["vector_id", "codes"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "vector_id long, codes array<int>")


def write(rows: DataFrame, folder: str, version: int = 2, vector: str = "vector", key: str = "vector_id", files: int = 1) -> None:
    """``rows`` in ``files`` files of ascending id ranges, by the data source below.  Each file has dense rows from 0."""
    wanted = [c for c in ("source_file", "start_time_ms", "duration_ms", "bpm", "tags") if c in rows.columns and version == 2]
    from tessera.sources.datasource import VdbSource

    rows.sparkSession.dataSource.register(VdbSource)
    rows.select(F.col(key).cast("long").alias("vector_id"), F.col(vector).cast("array<float>").alias("vector"), *wanted).repartitionByRange(files, "vector_id").sortWithinPartitions("vector_id").write.format("vdb").option("path", folder).option("version", version).mode("append").save()


def merge(spark: SparkSession, base: str, rows: DataFrame, folder: str, version: int = 2) -> None:
    """``base``'s rows and, numbered on from them, ``rows`` (vector_id, vector, metadata) in a new file."""
    old = read(spark, base)
    top = old.agg(F.coalesce(F.max("vector_id") + 1, F.lit(0))).first()[0]
    new = rows.withColumn("vector_id", F.col("vector_id") + top)
    write(old.unionByName(new, allowMissingColumns=True), folder, version)
