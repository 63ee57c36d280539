"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``depth`` bytes, most significant digit
first, and a group that a digit leaves with one member goes no further; what is equal
after the last digit are exactly the repeated windows.  A digit is eight bytes of the
text itself, so the order and the equality are those of the bytes.

So that not every byte of a corpus becomes a row, suffixes reach the sort in runs:

1. They are dealt by the anchor of their window: its least-hashed substring of 40
   bytes, the leftmost of equals.  Equal windows have equal anchors at equal places,
   so they meet; neighbouring windows mostly share one, so a run of them travels as
   one row.  An anchor that occurs once holds no repeated window.
2. Runs whose whole stretches of bytes have equal 128-bit cryptographic digests
   (BLAKE2b) are equal windows throughout; one stands for them all in the sort.
3. Each anchor's unequal stretches are sorted: digits of eight bytes from offset 0 to
   ``depth``, groups of one dropped after every pass.

An anchor with over ``split`` unequal stretches is dealt by its place in the window
too: windows that hold it at different places are unequal.  One with over ``hot``
sends its windows' digests, one by one, to a grouped count, so no group is unbounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytesops import WindowHasher, leftmost_argmin
from tessera.llm.shared import Scratch, as_bytes, free, groups, partitions_for, release, whole

DEPTH = 200
ANCHOR = 40
HOT = 20_000
#: Unequal stretches of an anchor from which its windows are dealt by the anchor's place in them, in blocks of ``PLACES``.
SPLIT, PLACES = 500, 16
#: Bytes of a digit.
DIGIT = 8
_BLOCK = 1 << 18

_RUNS = "a long, s binary, doc_id long, h long, lo int, n int, at int"
_STRETCHES = "a long, part int, many int, hot boolean, doc_id long, h long, lo int, raw binary"
_KEY = ["doc_id", "h"]


def _blocks(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into blocks, or one long text in overlapping ones: bytes, and of each piece its text, its start in the block and its start in the text."""
    some = [i for i, t in enumerate(texts) if len(t) >= depth]
    for lo, hi in groups([len(texts[i]) for i in some], _BLOCK):
        own = some[lo:hi]
        if len(own) == 1 and len(texts[own[0]]) > 4 * _BLOCK:
            text = texts[own[0]]
            for at in range(0, len(text) - depth + 1, _BLOCK):
                yield np.frombuffer(text, np.uint8, min(_BLOCK + depth - 1, len(text) - at), at), np.array([own[0]]), np.array([0]), np.array([at])
        else:
            starts = np.zeros(len(own), dtype=np.int64)
            np.cumsum([len(texts[i]) for i in own[:-1]], out=starts[1:])
            yield np.frombuffer(b"".join(texts[i] for i in own), np.uint8), np.array(own), starts, np.zeros(len(own), dtype=np.int64)


def _digest(raw: memoryview) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _runs(depth: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("h")
            for data, own, starts, at in _blocks(as_bytes(batch.column("text")), depth):
                hasher = WindowHasher(data)
                grams = hasher.all_of(anchor)
                best = leftmost_argmin(grams, depth - anchor + 1)
                piece = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(data))))[: len(best)]
                ends = np.append(starts[1:], len(data))
                fresh = np.ones(len(best), dtype=bool)
                fresh[1:] = (best[1:] != best[:-1]) | (piece[1:] != piece[:-1])
                lo = np.flatnonzero(fresh)
                which = piece[lo]
                hi = np.minimum(np.append(lo[1:], len(best)), ends[which] - depth + 1)  # windows stay in their text
                good = hi > lo
                lo, hi, which = lo[good], hi[good], which[good]
                n = hi - lo
                raw = memoryview(np.ascontiguousarray(data))
                stretch = [_digest(raw[i:j]) for i, j in zip(lo.tolist(), (hi + depth - 1).tolist(), strict=True)]
                rows = pa.array(own[which])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[best[lo]].view(np.int64)), pa.array(stretch, pa.binary()), ids.take(rows), hashes.take(rows), pa.array((lo - starts[which] + at[which]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((best[lo] - lo).astype(np.int32))],
                    names=["a", "s", "doc_id", "h", "lo", "n", "at"],
                )
        release()

    return run


def _parts(lo: np.ndarray, n: np.ndarray, at: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut by the anchor's place in their windows, if ``wide``: run, part, and first window and number of windows of each."""
    last = at - n + 1  # the anchor's place in the run's last window
    first_part, last_part = np.where(wide, at // PLACES, 0), np.where(wide, last // PLACES, 0)
    count = first_part - last_part + 1
    run = np.repeat(np.arange(len(lo)), count)
    part = first_part[run] - (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    high = np.where(wide[run], np.minimum(at[run], part * PLACES + PLACES - 1), at[run])
    low = np.where(wide[run], np.maximum(last[run], part * PLACES), last[run])
    return run, part, lo[run] + at[run] - high, high - low + 1


def _stretches(depth: int, split: int):
    """Each text's wanted runs: the bytes of each run, or of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wants = as_bytes(batch.column("text")), batch.column("wants")
            flat = wants.flatten()
            rows = np.repeat(np.arange(len(texts)), np.diff(wants.offsets.to_numpy()))
            get = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
            of, part, lo, n = _parts(get("lo"), get("n"), get("at"), (get("kinds") > split) & ~get("hot"))
            rows = rows[of]
            for i, j in groups((n + depth).tolist(), 8 << 20):
                raw = [texts[r][a : a + k + depth - 1] for r, a, k in zip(rows[i:j].tolist(), lo[i:j].tolist(), n[i:j].tolist(), strict=True)]
                take, own = pa.array(rows[i:j]), pa.array(of[i:j])
                yield pa.RecordBatch.from_arrays(
                    [flat.field("a").take(own), pa.array(part[i:j].astype(np.int32)), flat.field("many").take(own), flat.field("hot").take(own), batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(lo[i:j].astype(np.int32)), pa.array(raw, pa.binary())],
                    names=[c.split()[0] for c in _STRETCHES.split(", ")],
                )
        release()

    return run


def _windows(raw: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All stretches one after another, and of each window its stretch, its place in it and its start in all of them."""
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = sizes - depth + 1
    which = np.repeat(np.arange(len(raw)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(b"".join(raw), np.uint8), which, place, starts[which] + place


def _radix(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """The windows at ``starts`` that another of the same ``group`` equals, in order of group and bytes.

    Most significant digit first: a pass orders the members of each group by their next
    eight bytes, splits it where they differ, and drops what is left alone.  ``group``
    must ascend.
    """
    padded = np.concatenate([data, np.zeros(DIGIT, dtype=np.uint8)])
    word = np.zeros(len(data), dtype=np.uint64)
    for k in range(DIGIT):
        word |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * (DIGIT - 1 - k))
    alive, number = np.arange(len(starts)), group
    for offset in range(0, depth, DIGIT):
        if not len(alive):
            break
        digit = word[starts[alive] + offset] >> np.uint64(8 * max(0, DIGIT - (depth - offset)))
        fresh = np.ones(len(alive), dtype=bool)
        fresh[1:] = number[1:] != number[:-1]
        member = np.cumsum(fresh) - 1
        unlike = np.zeros(len(alive), dtype=bool)
        unlike[1:] = ~fresh[1:] & (digit[1:] != digit[:-1])
        if unlike.any():  # only groups that hold different digits are ordered
            mixed = np.flatnonzero((np.bincount(member, weights=unlike) > 0)[member])
            order = mixed[np.lexsort((digit[mixed], member[mixed]))]
            alive[mixed], digit[mixed] = alive[order], digit[order]
            fresh[1:] |= digit[1:] != digit[:-1]
            member = np.cumsum(fresh) - 1
        stays = (np.bincount(member) > 1)[member]
        alive, number = alive[stays], member[stays]
    return alive


def _spans(rows: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts of each row, as (row, from, to)."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(rows)) - 1 if len(at) else at
    return rows[at], starts[at], starts[last] + depth


def _ordered(depth: int):
    """Stretches dealt by anchor and part, sorted by them: the windows of each are radix-sorted in memory, at most ``HOT`` stretches at once."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        keys = np.stack([table.column(c).to_numpy() for c in ("a", "part")])
        number = np.cumsum(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) - 1
        data, which, place, starts = _windows(table.column("raw").to_pylist(), depth)
        alive = _radix(data, starts, number[which], depth)
        many = table.column("many").to_numpy()
        alive = alive[many[which[alive]] == 1]  # runs with equals are removed already
        row, start, end = _spans(which[alive], place[alive], depth)
        lo = table.column("lo").to_numpy()[row]
        take = pa.array(row)
        key = [table.column(c).combine_chunks().take(take) for c in _KEY]
        return pa.RecordBatch.from_arrays([*key, pa.array((lo + start).astype(np.int64)), pa.array((lo + end).astype(np.int64))], names=[*_KEY, "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # What is held ends where another group begins; a batch is cut at its last change, so that little is held.
            ends = [(c.column("a")[k].as_py(), c.column("part")[k].as_py()) for c, k in ([(held[-1], -1)] if held else [(batch, 0)])]
            keys = np.stack([batch.column(c).to_numpy() for c in ("a", "part")])
            before = np.concatenate([np.array(ends[0])[:, None], keys[:, :-1]], axis=1)
            change = np.flatnonzero((keys != before).any(axis=0))
            if len(change):
                held.append(batch.slice(0, int(change[-1])))
                yield emit(pa.Table.from_batches(held))
                held, batch = [], batch.slice(int(change[-1]))
            held.append(batch)
        if held:
            yield emit(pa.Table.from_batches(held))
        release()

    return run


def _fingerprints(depth: int):
    """Single windows of hot anchors, keyed by their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            for i, j in groups([len(r) for r in raw], 1 << 20):
                data, which, place, starts = _windows(raw[i:j], depth)
                view = memoryview(np.ascontiguousarray(data))
                key = [_digest(view[k : k + depth]) for k in starts.tolist()]
                part = batch.slice(i, j - i)
                take = pa.array(which)
                lo = part.column("lo").to_numpy()[which] + place
                yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in ("a", "many", *_KEY)] + [pa.array(lo.astype(np.int64)), pa.array(key, pa.binary())], names=["a", "many", *_KEY, "lo", "w"])
        release()

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by (from, to) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.ones(len(spans), dtype=bool)
    first[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(first)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


def repeated_spans(docs: DataFrame, scratch: Scratch, depth: int = DEPTH, anchor: int = ANCHOR, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """doc_id, h (hash of the text) and spans (array of lo << 32 | hi, not merged) of each text with a window of ``depth`` bytes that also starts anywhere else.

    Counts behind a join are written first: else the join keeps their partitioning, and
    all rows of a hot anchor in one task.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumn("h", F.xxhash64("text"))
    long = texts.filter(F.octet_length("text") >= depth)
    runs = scratch.keep(long.mapInArrow(_runs(depth, anchor), _RUNS), "runs")

    # Anchors that occur once hold no repeated window.
    twice = scratch.keep(runs.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1").select("a"), "twice")
    left = scratch.keep(runs.join(twice, "a"), "left")
    scratch.drop("runs")

    # Equal stretches; the first of them stands for the rest.
    # Windows of the others are repeated: what a text has of `left` and not of the unique stretches (told below, by text).
    kinds = scratch.keep(left.groupBy("a", "s").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "h", "lo", "n", "at")).alias("r")), "kinds")
    # Anchors with unequal stretches of which one at least has no equal are sorted.
    open_ = scratch.keep(kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.min("many").alias("least")).filter("kinds > 1 and least = 1"), "open")
    wanted = kinds.join(open_.select("a", "kinds"), "a").select("a", F.least("many", F.lit(2)).cast("int").alias("many"), "kinds", (F.col("kinds") > hot).alias("hot"), "r.*")
    per_text = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("a", "many", "kinds", "hot", "lo", "n", "at")).alias("wants"))
    per_text = per_text.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "wants")
    both = long.join(per_text, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h"))).select(*_KEY, "text", "wants")
    raw = scratch.keep(both.mapInArrow(_stretches(depth, split), _STRETCHES), "stretches")
    size = raw.filter("not hot").agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    cold = raw.filter("not hot").select("a", "part", "many", *_KEY, "lo", "raw").repartition(partitions_for(size, 4 << 20), "a", "part").sortWithinPartitions("a", "part").mapInArrow(_ordered(depth), "doc_id long, h long, lo long, hi long")
    single = raw.filter("hot").select("a", "many", *_KEY, "lo", "raw").mapInArrow(_fingerprints(depth), "a long, many int, doc_id long, h long, lo long, w binary")
    again = scratch.keep(single.groupBy("a", "w").agg(F.count("*").alias("c")).filter("c > 1").select("a", "w"), "again")
    hot_ones = single.filter("many = 1").join(again, ["a", "w"], "left_semi").select(*_KEY, "lo", (F.col("lo") + depth).alias("hi"))
    stretch = [*_KEY, F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("n") + (depth - 1)).cast("long").alias("hi")]
    spans = left.select(*stretch, F.lit(0).alias("kind")).unionByName(kinds.filter("many = 1").select("r.*").select(*stretch, F.lit(1).alias("kind"))).unionByName(cold.unionByName(hot_ones).withColumn("kind", F.lit(2)))
    code = F.shiftleft("lo", 32).bitwiseOR(F.col("hi"))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, code))
    per_text = spans.groupBy(*_KEY).agg(of(0).alias("all"), of(1).alias("alone"), of(2).alias("sorted")).select(*_KEY, F.concat(F.array_except("all", "alone"), "sorted").alias("spans"))
    out = scratch.keep(per_text.filter(F.size("spans") > 0), "spans")
    for name in ("twice", "left", "kinds", "open", "stretches", "again"):
        scratch.drop(name)
    return out


def _with_spans(docs: DataFrame, depth: int, anchor: int, hot: int, split: int) -> tuple[DataFrame, str, str]:
    """``docs`` with each whole text and its spans, and the names of those two columns."""
    scratch = Scratch(docs.sparkSession)
    text, hashed, spans, of, of_h = (free(name, docs) for name in ("_text", "_h", "_spans", "_span_id", "_span_h"))
    found = repeated_spans(docs, scratch, depth, anchor, hot, split).select(F.col("doc_id").alias(of), F.col("h").alias(of_h), F.col("spans").alias(spans))
    texts = docs.withColumn(text, whole()).withColumn(hashed, F.xxhash64(text))
    return texts.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(hashed) == F.col(of_h)), "left").drop(of, of_h, hashed), text, spans


def _cut(raw: bytes, spans: list[int] | None) -> tuple[bytes, int, int]:
    if not spans:
        return raw, 0, 0
    codes = np.array(spans, dtype=np.int64)
    runs = merged(np.stack([codes >> 32, codes & 0xFFFFFFFF], axis=1))
    kept, at = [], 0
    for lo, hi in runs.tolist():
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return b"".join(kept), int((runs[:, 1] - runs[:, 0]).sum()), len(runs)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("_text"))
        cut = [_cut(t, s) for t, s in zip(texts, batch.column("_spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )
    release()


def repeated_report(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs``.

    A byte is removed if a window of ``depth`` bytes that covers it also starts
    anywhere else, in its own text or another; windows are judged on the input.
    Null texts are empty; texts under ``depth`` bytes keep all.  Rows that repeat
    another are texts like any: each is the other's repetition.  A null doc_id stays
    null.  Other columns are not read.
    """
    rows, *_ = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), depth, anchor, hot, split)
    return rows.select("doc_id", "_text", "_spans").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _texts(text: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nulls = as_bytes(batch.column(text)), batch.column("text").is_null().to_pylist()
            out = [None if null else _cut(t, s)[0].decode("utf-8", "ignore") for t, s, null in zip(texts, batch.column(spans).to_pylist(), nulls, strict=True)]
            columns = {name: batch.column(name) for name in batch.schema.names if name not in (text, spans)}
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        release()

    return run


def without_repeats(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``, and ``n_chars``, if there, counted anew.

    A character of which only some bytes are covered goes whole.  Rows stay, with an
    empty text if all is repeated; a null text stays null, a null doc_id null, and rows
    that repeat another are each other's repetition.  An empty table stays empty.
    Columns of any other name are kept as they are.
    """
    rows, text, spans = _with_spans(docs, depth, anchor, hot, split)
    n_chars = [f for f in docs.schema.fields if f.name == "n_chars"]
    schema = docs.withColumn("n_chars", F.col("n_chars").cast("long")).schema if n_chars else docs.schema
    return rows.mapInArrow(_texts(text, spans), schema)
