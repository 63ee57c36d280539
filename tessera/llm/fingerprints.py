"""Locality-sensitive document digests from hashed byte triplets.

Every window of five bytes gives six triplets (its first byte with two of the other
four), each hashed to one of 128 buckets.  The digest holds the length on a logarithmic scale, the
ratios of the bucket counts' quartiles, and for each bucket the quartile that its
count falls into.  Two digests are compared by a difference score with an upper
bound, which makes it a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, groups, whole

BUCKETS = 128
#: Difference from which two digests count as nothing alike.
MOST = 3 * BUCKETS // 2
#: Difference of two quartile codes: far quartiles count more than near ones.
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)
_PARTNERS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Triplet counts in each bucket, a row for each text; windows do not cross texts."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    for lo, hi in groups([len(t) for t in texts], 1 << 18):
        if hi == lo + 1:  # one text, maybe long: block by block with an overlap
            text = texts[lo]
            for at in range(0, len(text), 1 << 20):
                part = np.frombuffer(text, np.uint8, min((1 << 20) + 4, len(text) - at), at)
                out[lo] += _count(part, None, 1)[0]
            continue
        sizes = [len(t) for t in texts[lo:hi]]
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        out[lo:hi] = _count(data, np.array(sizes), hi - lo)
    return out


def _count(data: np.ndarray, sizes: np.ndarray | None, n: int) -> np.ndarray:
    last = len(data) - 4
    if last <= 0:
        return np.zeros((n, BUCKETS), dtype=np.int64)
    wide = data.astype(np.uint32)
    if sizes is None:
        owner, valid = np.zeros(last, dtype=np.uint32), None
    else:
        doc = np.repeat(np.arange(n, dtype=np.uint32), sizes)
        owner, valid = doc[:last], doc[:last] == doc[4:]
    base = owner * np.uint32(BUCKETS)
    if valid is not None:
        wide_at = np.flatnonzero(valid)
        base = base[wide_at]
    total = np.zeros(n * BUCKETS, dtype=np.int64)
    for salt, (i, j) in enumerate(_PARTNERS):
        code = wide[:last] + (wide[i : last + i] << np.uint32(8)) + (wide[j : last + j] << np.uint32(16))
        if valid is not None:
            code = code[wide_at]
        bucket = ((code + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(25)
        total += np.bincount(base + bucket, minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS)


def length_code(n_bytes: int) -> int:
    return min(255, int(8 * math.log2(n_bytes + 1)))


def digests(texts: list[bytes]) -> list[str]:
    """Hex digests: length (1 byte), quartile ratios (1 byte), four bucket quartiles a byte (32 bytes)."""
    counts = bucket_counts(texts)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = code[:, 0::4] | (code[:, 1::4] << 2) | (code[:, 2::4] << 4) | (code[:, 3::4] << 6)
    safe = np.maximum(q3, 1)
    ratio = ((q1 * 15 // safe) << 4 | (q2 * 15 // safe)).astype(np.uint8)[:, 0]
    return [f"{length_code(len(t)):02x}{r:02x}{row.tobytes().hex()}" for t, r, row in zip(texts, ratio.tolist(), packed.astype(np.uint8), strict=True)]


def _codes(digest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digest)), np.uint8).reshape(len(digest), -1)
    body = raw[:, 2:]
    return raw[:, :2].astype(np.int64), np.stack([(body >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(digest), BUCKETS)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 - difference / MOST, 0 at least, of each pair of digests.  Equal digests give 1."""
    if not a:
        return np.zeros(0)
    (head_a, body_a), (head_b, body_b) = _codes(a), _codes(b)
    far = _STEP[body_a, body_b].sum(axis=1)
    length = np.abs(head_a[:, 0] - head_b[:, 0])
    ratio = np.abs((head_a[:, 1] >> 4) - (head_b[:, 1] >> 4)) + np.abs((head_a[:, 1] & 15) - (head_b[:, 1] & 15))
    return np.maximum(0.0, 1.0 - (far + length + ratio) / MOST)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests([t.encode() for t in batch.column("text").to_pylist()]), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


# -- each document against its edited text and the next document ----------------

_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_MARKED = f"{_OUT}, part int, kind string, text string"


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many of ``after``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(ids: list[int | None], texts: list[str], after: list[str]) -> pa.RecordBatch:
    changed = [edited(t, a).encode() for t, a in zip(texts, after, strict=True)]
    own = digests([t.encode() for t in texts])
    # Mostly the next text is the next row, whose digest is there already.
    shared = len(texts) > 1 and all(a is t for a, t in zip(after, texts[1:]))
    following = [*own[1:], *digests([after[-1].encode()])] if shared else digests([a.encode() for a in after])
    new = digests(changed)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), pa.array(own, pa.string()), pa.array(new, pa.string()), pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, following), pa.float64())],
        names=[c.split()[0] for c in _OUT.split(", ")],
    )


def _marked(batch: pa.RecordBatch, part: int, kind: str, texts: list[str] | None = None) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.string()), pa.array(texts or [None] * n, pa.string())], names=[*batch.schema.names, "part", "kind", "text"])


def _border(doc: int | None, text: str, part: int, kind: str) -> pa.RecordBatch:
    row = pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *(pa.array([None], t) for t in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))], names=[c.split()[0] for c in _OUT.split(", ")])
    return _marked(row, part, kind, [text])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition meet their successor; the first and the last are also sent on as borders."""
    part = TaskContext.get().partitionId()
    held: tuple[int | None, str] | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            ids, texts = some.column("doc_id").to_pylist(), some.column("text").to_pylist()
            if held is None:
                yield _border(ids[0], texts[0], part, "head")
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if len(ids) > 1:
                yield _marked(_compare(ids[:-1], texts[:-1], texts[1:]), part, "whole")
            held = ids[-1], texts[-1]
    if held is not None:
        yield _border(*held, part, "tail")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            if some.num_rows:
                yield _compare(*(some.column(c).to_pylist() for c in ("doc_id", "text", "after")))


def next_likeness(docs: DataFrame) -> DataFrame:
    """Each document's digest against its edited text's and the next document's, by descending doc_id; after the last comes the first.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  Null texts are empty.  Equal doc_ids are ordered by text, null ones
    come last; repeated rows are documents each.  A table's only document is its own
    next.  An empty table gives no rows.  Other columns are not read.

    Texts are dealt by ranges of doc_id once; a partition's last row meets the first
    of the next non-empty one in a join of one row for each partition.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    n = max(texts.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    # Ranges of doc_id alone: a sample of the range keys goes to the driver, and texts are no keys.
    dealt = texts.repartitionByRange(n, order[0]).sortWithinPartitions(*order)
    found = scratch.keep(dealt.mapInArrow(_neighbours, _MARKED), "found")
    names = [c.split()[0] for c in _OUT.split(", ")]
    parts = [r["part"] for r in found.filter("kind = 'head'").select("part").orderBy("part").collect()]  # one for each partition
    if not parts:
        return found.select(names)
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    tails = found.filter("kind = 'tail'").select("part", "doc_id", "text").join(follow, "part")
    heads = found.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    borders = tails.join(heads, "next_part").select("doc_id", "text", "after").mapInArrow(_pairs, _OUT)
    return found.filter("kind = 'whole'").select(names).unionByName(borders)
