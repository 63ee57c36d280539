"""``spark.read.format("vdb")`` and ``df.write.format("vdb")``: vector files split by row ranges.

Row offsets are arithmetic, so a file of any size is read by as many tasks as its rows
fill.  Paths must be on a file system that driver and executors mount alike.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.sources import vdb

#: Bytes of vectors that one task reads.
SPLIT = 64 << 20


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _files(path: str) -> list[str]:
    path = _local(path)
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".vdb") and not f.startswith((".", "_")))


class VdbSource(DataSource):
    """Options: path; for reading rows_per_split; for writing version (1 or 2)."""

    @classmethod
    def name(cls) -> str:
        return "vdb"

    def schema(self) -> str:
        return "vector_id long, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, [f.name for f in schema.fields], overwrite)


@dataclass
class _Range(InputPartition):
    path: str
    base: int
    lo: int
    hi: int

    def __init__(self, path: str, base: int, lo: int, hi: int):
        super().__init__(None)
        self.path, self.base, self.lo, self.hi = path, base, lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows_per_split", 0))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        base = 0
        for path in _files(self.path):
            with open(path, "rb") as f:
                header = vdb.read_header(f.read(vdb.HEADER_2))
            if header.flags & vdb.PQ:
                raise vdb.FormatError("codes have no raw vectors")
            vdb.check_size(header, os.path.getsize(path))
            each = self.rows or max(1, SPLIT // max(1, 4 * header.dim))
            out += [_Range(path, base, lo, min(lo + each, header.count)) for lo in range(0, header.count, each)]
            base += header.count
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            header = vdb.read_header(f.read(vdb.HEADER_2))
            f.seek(header.vectors_at + 4 * header.dim * partition.lo)
            for lo in range(partition.lo, partition.hi, 8192):
                n = min(8192, partition.hi - lo)
                flat = np.frombuffer(f.read(4 * header.dim * n), dtype="<f4").astype(np.float32)
                offsets = np.arange(n + 1, dtype=np.int32) * header.dim
                yield pa.RecordBatch.from_arrays([pa.array(partition.base + np.arange(lo, lo + n)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["vector_id", "vector"])


@dataclass
class _Done(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    """Each task writes a file under a temporary name; the commit renames them, so readers never see a part."""

    def __init__(self, options, names: list[str], overwrite: bool):
        self.folder, self.version, self.names, self.overwrite = _local(options["path"]), int(options.get("version", 2)), names, overwrite

    def write(self, rows) -> _Done:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        at = f"{self.folder}/.part-{context.partitionId():05d}-{context.taskAttemptId()}.tmp"
        count = dim = 0
        metadata: list[dict] = []
        with open(at, "wb") as f:
            f.write(b"\0" * (vdb.HEADER_1 if self.version == 1 else vdb.HEADER_2))
            for row in rows:
                vector = np.asarray(row["vector"], dtype="<f4")
                if count and len(vector) != dim:
                    raise vdb.FormatError(f"a vector of {len(vector)} among those of {dim}")
                dim, count = len(vector), count + 1
                f.write(vector.tobytes())
                if len(self.names) > 2:
                    metadata.append({k: row[k] for k in self.names[2:]})
            if self.version == 1:
                header = vdb.Header(1, count, dim)
            else:
                end = f.tell()
                if metadata:
                    f.write(vdb.pack_metadata(metadata))
                header = vdb.Header(2, count, dim, vdb.METADATA * bool(metadata), 0, vdb.HEADER_2, 0, end if metadata else 0)
            f.seek(0)
            f.write(header.pack())
        if not count:
            os.remove(at)
            return _Done([])
        return _Done([at])

    def commit(self, messages) -> None:
        if self.overwrite:
            for path in _files(self.folder):
                os.remove(path)
        for message in messages:
            for at in message.paths if message else []:
                number = os.path.basename(at).split("-")[1]
                attempt = os.path.basename(at).split("-")[2].removesuffix(".tmp")
                os.replace(at, f"{self.folder}/part-{number}-{attempt}.vdb")

    def abort(self, messages) -> None:
        for message in messages:
            for at in message.paths if message else []:
                if os.path.exists(at):
                    os.remove(at)
