"""Near-duplicate documents: MinHash samples folded into odd sketches, banded candidates, exact confirmation.

A document's set is its distinct 5-word shingles (all its words as one, if fewer).
Each class of equal sets is one node, whatever its number of copies.  250 MinHash
samples in 50 bands of five give buckets; a pair with similarity 0.75 shares none
with probability (1 - 0.75**5)**50 = 1.3e-6.  The samples are also folded into a
parity bitmap of 1024 bits, whose XOR population count estimates the similarity with
a standard error of 0.032 at 0.75: pairs estimated more than 0.18 too low, or whose
sizes rule them out, are left, and the rest confirmed on the full sets.  That leaves a
pair at similarity 0.75 with probability 7.5e-8, so bands and sketches together lose
it with 1.4e-6.

No bucket is expanded into its pairs.  Each member meets its bucket's smallest
node; confirmed links give components.  Only what still lies in different components of one bucket then meets:
blocks of its members meet in pairs, in tasks that give confirmed links alone, so no
list of pairs is made, and a bucket of one component, however large, costs one row
per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytesops import mix64, shingle_hashes, word_hashes
from tessera.llm.shared import Scratch, as_bytes, groups, release, small, whole

SHINGLE = 5
BANDS, ROWS = 50, 5
BITS = 1024
#: Estimated similarity may lie this much under the least one: so much that sketches lose fewer pairs than bands do.
MARGIN = 0.18
#: Members that meet one hub in one run of sorted rows.
FAN = 128
#: Members of a block; two blocks of a bucket meet in one task.
CELL = 256
#: Links that one task joins in memory at most (about 100 MB); more are joined by distributed passes.
LOCAL = 500_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)

_SKETCHED = "doc_id long, h long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"


def shingle_set(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingle_hashes(word_hashes(raw), size))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (n x BANDS) and odd sketches (n x BITS / 64) of non-empty sets."""
    flat = np.concatenate(sets)
    first = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=first[1:])
    low = (flat >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((BANDS * ROWS, len(sets)), dtype=np.uint64)
    for i in range(BANDS * ROWS):
        samples[i] = np.minimum.reduceat(low * _A[i] + _B[i], first)
    which = np.arange(BANDS * ROWS, dtype=np.uint64)[:, None]
    tagged = mix64(samples + (which << np.uint64(32)))
    bands = tagged.reshape(BANDS, ROWS, -1).copy()
    key = bands[:, 0]
    for r in range(1, ROWS):
        key = mix64(key + bands[:, r] * np.uint64(2 * r + 1))
    bit = (tagged >> np.uint64(54)).astype(np.int64) + np.arange(len(sets)) * BITS
    parity = (np.bincount(bit.ravel(), minlength=len(sets) * BITS) & 1).astype(np.uint8)
    sketch = np.packbits(parity.reshape(len(sets), BITS), axis=1).view(np.int64)
    return key.T.view(np.int64), sketch


def _lists(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    offsets = np.zeros(len(present) + 1, dtype=np.int32)
    np.cumsum(present * width, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        ids, hashes = batch.column("doc_id"), batch.column("h")
        for lo, hi in groups([len(t) for t in texts], 1 << 20):
            sets = [shingle_set(t) for t in texts[lo:hi]]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = n > 0
            some = [s for s in sets if len(s)]
            s1, s2 = np.zeros((2, len(sets)), dtype=np.uint64)
            keys = sketches = np.zeros((0, 1), dtype=np.int64)
            if some:
                keys, sketches = signatures(some)
                flat, first = np.concatenate(some), np.concatenate(([0], np.cumsum(n[full])[:-1]))
                s1[full] = np.add.reduceat(mix64(flat), first)
                s2[full] = np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), hashes.slice(lo, hi - lo), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _lists(keys, full), _lists(sketches, full)],
                names=["doc_id", "h", "n_shingles", "s1", "s2", "bands", "sketch"],
            )
    release()


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, a hash that tells apart the texts under one doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumn("h", F.xxhash64("text"))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_shingles, a 128-bit hash of the set (s1, s2), band hashes and odd sketch of each document."""
    return _texts(docs).mapInArrow(_sketch, _SKETCHED)


def distinct_sets(table: DataFrame) -> DataFrame:
    """A row for each set of :func:`sketched`: node (its number), doc (the smallest doc_id and h that have it), n, bands and sketch."""
    own = table.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    return own.select("s1", "s2", F.xxhash64("s1", "s2").alias("node"), "doc", "n", "bands", "sketch")


def most_differing(similarity: float) -> int:
    """XOR population count that is expected at a similarity."""
    return int(BITS / 2 * (1 - np.exp(-2 * (2 * BANDS * ROWS * (1 - similarity)) / BITS)))


def _maybe(a: str, b: str, least: int):
    """Whether two (n, sketch) structs may reach ``least``: by their sizes for certain, by their sketches with MARGIN to spare."""
    small_n, large_n = F.least(F.col(a)["n"], F.col(b)["n"]), F.greatest(F.col(a)["n"], F.col(b)["n"])
    differing = F.aggregate(F.zip_with(F.col(a)["sketch"], F.col(b)["sketch"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * small_n >= least * large_n) & (differing <= most_differing(least / 100 - MARGIN))


def _similar(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= least * (len(a) + len(b) - both)


def _confirm(least: int):
    """Rows sorted by hub, salt and kind: each hub's text (kind 0) comes before its members' (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = known = last = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for h, kind, member, text in zip(batch.column("hub").to_pylist(), batch.column("kind").to_pylist(), batch.column("member").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if (h, member) == last:  # the same row of the table again
                    continue
                last = h, member
                if kind == 0:
                    hub, known = h, shingle_set(text)
                elif hub == h and _similar(known, shingle_set(text), least):
                    out.append((h, member))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["hub", "member"])
        release()

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, least: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (hub, member) whose full sets have a similarity of ``least`` hundredths or more.

    ``pairs`` also names the documents to compare, as structs of doc_id and h: of and
    with.  Texts, not pairs of texts, travel: each member's once a pair, each hub's once
    for every FAN members, so a hub of any number of members is dealt over many tasks.
    Counts behind a join are written first: else the join keeps their partitioning,
    and all members of a hub in one task.
    """
    pairs = scratch.keep(pairs.select("hub", "member", "of", "with"), f"{name}-near")
    fan = scratch.keep(pairs.groupBy("hub").agg(F.ceil(F.count("*") / FAN).alias("fan")), f"{name}-fan")
    pairs = scratch.keep(pairs.join(small(fan, 16), "hub").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("fan"))).drop("fan"), f"{name}-pairs")
    wanted = pairs.select("hub", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("member"), "of.*").distinct().unionByName(
        pairs.select("hub", "salt", F.lit(1).alias("kind"), "member", "with.*"))
    rows = _texts(docs).join(small(wanted, 64), ["doc_id", "h"]).select("hub", "salt", "kind", "member", "text")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind", "member")
    return scratch.keep(dealt.mapInArrow(_confirm(least), "hub long, member long").distinct(), f"{name}-links")


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the components of (hub, member) links, in one task."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), strict=True):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    nodes = [x for x in top if find(x) != x]
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, scratch: Scratch, name: str, local: int = LOCAL) -> DataFrame:
    """(node, label): for each node of an edge (hub, member) but the smallest of its component, that smallest one.

    At most ``local`` edges, counted, are joined in one task's memory.  More go through
    alternating large-star and small-star passes; each pass is a grouped minimum and a
    join, and its edges are written before the next.
    """
    if edges.count() <= local:
        return edges.select("hub", "member").coalesce(1).mapInArrow(_union, "node long, label long")
    now = scratch.keep(edges.select(F.greatest("hub", "member").alias("u"), F.least("hub", "member").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    sign = None
    for turn in range(1, 100):
        if now.isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low-{turn}")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.keep(large, f"{name}-large-{turn}")
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least-{turn}")
        small_star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = scratch.keep(small_star.filter("u <> v").distinct(), f"{name}-{turn}")
        for done in (f"{name}-{turn - 1}", f"{name}-low-{turn}", f"{name}-large-{turn}", f"{name}-least-{turn}"):
            scratch.drop(done)
        now, before = after, sign
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


def near_duplicates(docs: DataFrame, least: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, a row for each document.

    ``least``: similarity in hundredths from which two documents are linked.

    Null and empty texts, and those without words, have no set: n_shingles 0, their own
    component, kept.  A document is a doc_id and a set: rows that repeat both give one
    row, and unequal sets under one doc_id are documents of their own, which link only
    what is like each of them.  A null doc_id can name no component: the row is linked
    with nothing and returned with a null component_id, kept.  An empty table gives no
    rows.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table = scratch.keep(sketched(docs), "sketched")
    sets = table.filter("n_shingles > 0 and doc_id is not null")
    nodes = scratch.keep(distinct_sets(sets), "nodes")

    members = nodes.select("node", F.posexplode("bands").alias("place", "band"))
    hubs = scratch.keep(members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1"), "hubs")
    shared = scratch.keep(members.join(hubs, "band").select("band", "place", "node", "hub", "size"), "shared")

    sketch = nodes.select("node", "doc", F.struct("n", "sketch").alias("sketch"))
    near = scratch.keep(shared.filter("node <> hub").select("hub", F.col("node").alias("member")).distinct(), "near")
    near = (
        near.join(sketch.select(F.col("node").alias("member"), F.col("doc").alias("with"), F.col("sketch").alias("a")), "member")
        .join(sketch.select(F.col("node").alias("hub"), F.col("doc").alias("of"), F.col("sketch").alias("b")), "hub")
        .filter(_maybe("a", "b", least))
    )
    links = confirmed(near, docs, least, scratch, "star")
    labels = scratch.keep(components(links, scratch, "first"), "labels")

    # What one bucket still holds in two components, the hub aside: every member has met it.
    apart = scratch.keep(
        shared.filter("size > 2").join(labels.select("node", "label"), "node", "left").select("band", "place", "node", "hub", F.coalesce("label", "node").alias("label")), "in-buckets")
    mixed = scratch.keep(apart.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("band"), "mixed")
    rest = scratch.keep(apart.filter("node <> hub").join(small(mixed, 8), "band").select("band", "place", "node", "label"), "apart")
    if rest.isEmpty():
        merged = spark.createDataFrame([], "label long, top long")
    else:
        merged = _second_pass(rest, nodes, docs, least, scratch)
    final = (
        nodes.select("s1", "s2", "node", F.col("doc.doc_id").alias("doc")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        .join(merged, "label", "left").select("s1", "s2", "doc", F.coalesce("top", "label").alias("component"))
    )
    final = scratch.keep(final, "joined")
    smallest = scratch.keep(final.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("nodes")), "smallest")
    # A node alone, as most are, is its own smallest.
    several = smallest.filter("nodes > 1").select("component", "component_id")
    final = scratch.keep(final.join(small(several, 16), "component", "left").select("s1", "s2", F.coalesce("component_id", "doc").alias("component_id")), "final")
    known = sets.select("doc_id", "n_shingles", "s1", "s2").distinct().join(final, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    alone = table.filter("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")).distinct()
    nameless = table.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    for name in ("hubs", "shared", "near", "labels", "in-buckets", "apart", "nodes", "joined"):
        scratch.drop(name)
    return known.unionByName(alone).unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _cells(rest: DataFrame, cell: int, scratch: Scratch) -> DataFrame:
    """``rest`` (band, place, node, label) with lo and hi: the pairs of blocks of its bucket that each member is needed in, and side.

    A component with over ``cell`` members in a bucket has blocks of its own, that do
    not meet each other; smaller ones share blocks.  A block has about ``cell`` members.
    """
    counts = scratch.keep(rest.groupBy("band", "label").agg(F.count("*").alias("c")), "counts")
    big = scratch.keep(counts.filter(F.col("c") > cell).select("band", F.col("label").alias("big"), F.ceil(F.col("c") / cell).alias("parts")), "big")
    little = scratch.keep(counts.filter(F.col("c") <= cell).groupBy("band").agg(F.ceil(F.sum("c") / cell).alias("parts")).select("band", F.lit(None).cast("long").alias("big"), "parts"), "little")
    spread = big.unionByName(little)
    blocks = spread.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).groupBy("band").agg(F.array_sort(F.collect_list(F.struct("big", "part"))).alias("blocks"))
    blocks = scratch.keep(blocks, "blocks")
    own = rest.join(small(big.select("band", F.col("big").alias("label"), "big", F.col("parts").alias("own")), 32), ["band", "label"], "left")
    own = own.join(small(little.select("band", F.col("parts").alias("shared")), 16), "band", "left").join(blocks, "band")
    part = F.when(F.col("big").isNotNull(), F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("label"), F.col("shared")))
    at = F.array_position("blocks", F.struct("big", part.cast("long").alias("part"))).cast("int")
    others = F.filter(F.transform("blocks", lambda b, k: F.struct(b["big"].alias("big"), (k + 1).alias("k"))), lambda b: F.col("big").isNull() | ~b["big"].eqNullSafe(F.col("big")))
    met = own.withColumn("at", at).select("band", "place", "node", "label", "at", F.explode(F.transform(others, lambda b: b["k"])).alias("other"))
    return met.select("band", "place", "node", "label", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at")


_CELL = "band long, place int, lo int, hi int, at int, node long, label long, doc_id long, h long, n long, bands array<long>, sketch array<long>"


def _pairs(rows: list[dict], least: int) -> Iterator[tuple[int, int]]:
    """Places of the members of different components in a cell that sizes and sketches let be alike.

    A pair is looked at in the first band that both share.
    """
    label, at, n = (np.array([r[k] for r in rows]) for k in ("label", "at", "n"))
    bands, sketch = np.array([r["bands"] for r in rows]), np.array([r["sketch"] for r in rows])
    place, alone = rows[0]["place"], rows[0]["lo"] == rows[0]["hi"]
    limit = most_differing(least / 100 - MARGIN)
    for i in range(len(rows) - 1):
        later = np.arange(i + 1, len(rows))
        later = later[(label[later] != label[i]) & (alone | (at[later] != at[i]))]
        later = later[100 * np.minimum(n[later], n[i]) >= least * np.maximum(n[later], n[i])]
        later = later[np.bitwise_count((sketch[later] ^ sketch[i]).view(np.uint64)).sum(axis=1) <= limit]
        later = later[~(bands[later, :place] == bands[i, :place]).any(axis=1)]
        for j in later.tolist():
            yield i, j


def _by_cell(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[list[dict]]:
    """The rows of each cell; a row that comes twice counts once."""
    held: list[dict] = []
    for batch in batches:
        rows = (batch.drop_columns(["text"]) if texts else batch).to_pylist()
        if texts:
            rows = [row | {"text": text} for row, text in zip(rows, as_bytes(batch.column("text")), strict=True)]
        for row in rows:
            if held and any(held[0][k] != row[k] for k in ("band", "lo", "hi")):
                yield held
                held = []
            if not held or held[-1]["node"] != row["node"]:
                held.append(row)
    if held:
        yield held


def _needed(least: int):
    """Of cells without texts, the rows that some pair needs."""
    names = [c.split()[0] for c in _CELL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for rows in _by_cell(batches, False):
            some = sorted({k for pair in _pairs(rows, least) for k in pair})
            if some:
                schema = schema or pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[t]) for c, t in (x.split() for x in _CELL.split(", "))])
                yield pa.RecordBatch.from_pylist([{c: rows[k][c] for c in names} for k in some], schema=schema)
        release()

    return run


def _meet(least: int):
    """Cells one after another; of each, the confirmed links between members of different components.

    Links that join nothing new in the cell are left out: a cell of n members gives
    n - 1 at most.
    """

    def links(rows: list[dict]) -> Iterator[tuple[int, int]]:
        sets: dict[int, np.ndarray] = {}
        top = {r["label"]: r["label"] for r in rows}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(rows[i]["text"])
            return sets[i]

        for i, j in _pairs(rows, least):
            a, b = find(rows[i]["label"]), find(rows[j]["label"])
            if a != b and _similar(of(i), of(j), least):
                top[max(a, b)] = min(a, b)
                yield rows[i]["label"], rows[j]["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches, True):
            out = list(links(rows))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["hub", "member"])
        release()

    return run


def _second_pass(rest: DataFrame, nodes: DataFrame, docs: DataFrame, least: int, scratch: Scratch, cell: int = CELL) -> DataFrame:
    """(label, top): components of the first pass that a link between members of one bucket joins.

    Sizes and sketches meet in the cells first; texts come only to those that a pair needs.
    """
    names = [c.split()[0] for c in _CELL.split(", ")]
    cells = scratch.keep(_cells(rest, cell, scratch), "cells")
    rows = cells.join(nodes.select("node", "doc.*", "n", "bands", "sketch"), "node").select(*names)
    dealt = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node")
    needed = scratch.keep(dealt.mapInArrow(_needed(least), _CELL), "needed")
    with_texts = _texts(docs).join(needed, ["doc_id", "h"])
    dealt = with_texts.select(*names, "text").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node")
    links = scratch.keep(dealt.mapInArrow(_meet(least), "hub long, member long").distinct(), "rest-links")
    return scratch.keep(components(links, scratch, "second").withColumnRenamed("label", "top").withColumnRenamed("node", "label"), "merged")
