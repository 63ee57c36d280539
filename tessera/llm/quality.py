"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network with calibrated probabilities.

A word (a run of letters, digits and non-ASCII bytes, or a run of punctuation, hashed to one of 8192
buckets) has a fixed sparse index vector.  Its context vector is the sum of its
neighbours' index vectors over the whole corpus: integer counts, summed exactly.  A
document is its words' mean vectors, the mean product of neighbouring words' vectors,
and the shares of repeated neighbours and of classes of words.  The network is fitted
with numpy on at most ``most_rows`` labelled documents, and its logits are divided by
a temperature that minimises the loss on a fifth of them, held aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytesops import SPACE, mix64, span_hashes
from tessera.llm.shared import as_bytes, free, groups, release, whole

BUCKETS, DIMS, NONZERO = 8192, 32, 2
#: Neighbours on either side that count as context.
REACH = 2
#: Labelled documents that the network is fitted on, at most; the smallest hashes of doc_id.
MOST_ROWS = 20_000
THRESHOLD = 0.3
_CLASSES = 5

_seed = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(17)).reshape(BUCKETS, NONZERO)
#: Places and signs of the index vectors' components.
_PLACE = (_seed % np.uint64(DIMS)).astype(np.int64)
_SIGN = np.where(_seed >> np.uint64(63), 1, -1).astype(np.int64)
_INDEX = np.zeros((BUCKETS, DIMS), dtype=np.float32)
for _k in range(NONZERO):
    np.add.at(_INDEX, (np.arange(BUCKETS), _PLACE[:, _k]), _SIGN[:, _k])

#: 0 white space, 1 a byte of a word, 2 punctuation and controls.
_KIND = np.full(256, 2, dtype=np.int8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[SPACE] = 0


@dataclass
class Words:
    """Words of several texts: bucket, class, and where each text's begin."""

    bucket: np.ndarray
    shape: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Words of texts; a text is cut into blocks of a megabyte at any change of byte class."""
    buckets, shapes, counts = [], [], []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        n = at = 0
        while at < len(data):
            end = min(len(data), at + (1 << 20))
            while end < len(data) and _KIND[data[end]] == _KIND[data[end - 1]]:
                end += 1
            b, s = _words(data[at:end])
            buckets.append(b)
            shapes.append(s)
            n, at = n + len(b), end
        counts.append(n)
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    empty = np.zeros(0, dtype=np.int64)
    return Words(np.concatenate([empty, *buckets]), np.concatenate([empty, *shapes]), first)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _KIND[data]
    starts = np.flatnonzero(np.diff(kind, prepend=np.int8(0)) != 0)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bucket = (span_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    head, tail = data[starts], data[ends - 1]
    upper = lambda x: (x >= 65) & (x <= 90)
    shape = np.select([kind[starts] == 2, (head >= 48) & (head <= 57), upper(head) & upper(tail) & (ends - starts > 1), upper(head)], [1, 2, 3, 4], 0)
    return bucket, shape.astype(np.int64)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int, Words]]:
    for lo, hi in groups([len(t) for t in texts], 1 << 19):
        yield lo, hi, words_of(texts[lo:hi])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * DIMS, dtype=np.int64)
    for batch in batches:
        for _, _, words in _blocks(as_bytes(batch.column("text"))):
            doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
            for far in range(1, REACH + 1):
                same = np.flatnonzero(doc[far:] == doc[:-far]) if len(doc) > far else np.zeros(0, dtype=np.int64)
                left, right = words.bucket[same], words.bucket[same + far]
                for k in range(NONZERO):
                    for word, other in ((left, right), (right, left)):
                        total += np.bincount(word * DIMS + _PLACE[other, k], weights=_SIGN[other, k], minlength=BUCKETS * DIMS).astype(np.int64)
    release()
    table = total.reshape(BUCKETS, DIMS)
    some = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, d]) for d in range(DIMS))], names=["bucket", *(f"c{d}" for d in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of the buckets, over all of ``docs``: BUCKETS rows reach the driver, however large the corpus."""
    names = [f"c{d}" for d in range(DIMS)]
    counted = docs.select(whole().alias("text")).mapInArrow(_contexts, "bucket long, " + ", ".join(f"{c} long" for c in names))
    rows = counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    out = np.zeros((BUCKETS, DIMS), dtype=np.float64)
    out[rows["bucket"].to_numpy()] = rows[names].to_numpy(dtype=np.float64)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of pooled vectors and shares for each text; zeros for one without words."""
    width = 3 * DIMS + 2 + _CLASSES
    out = np.zeros((len(texts), width), dtype=np.float32)
    for lo, hi, words in _blocks(texts):
        n = np.diff(words.first)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        begin = words.first[:-1][some]
        count = n[some][:, None].astype(np.float32)
        context, own = vectors[words.bucket], _INDEX[words.bucket]
        onward = np.zeros_like(context)
        onward[:-1] = context[:-1] * context[1:]
        again = np.zeros(len(words.bucket), dtype=np.float32)
        again[:-1] = words.bucket[:-1] == words.bucket[1:]
        ends = words.first[1:][some] - 1
        onward[ends], again[ends] = 0, 0
        rows = out[lo:hi]
        pool = lambda x: np.add.reduceat(x, begin, axis=0) / count
        rows[some, :DIMS] = pool(context)
        rows[some, DIMS : 2 * DIMS] = pool(own)
        rows[some, 2 * DIMS : 3 * DIMS] = pool(onward)
        rows[some, 3 * DIMS] = pool(again[:, None])[:, 0]
        rows[some, 3 * DIMS + 1] = np.log1p(n[some]) / 10
        for c in range(_CLASSES):
            rows[some, 3 * DIMS + 2 + c] = pool((words.shape == c).astype(np.float32)[:, None])[:, 0]
    return out


@dataclass
class Network:
    """Two dense layers over standardised features; ``temperature`` divides the logit."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.logits(features(texts, self.vectors).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Network:
    """Adam on the cross-entropy with weight decay; every fifth row is held aside for the temperature.  Without both labels the score is the base rate, a half if there is none."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    d = x.shape[1]
    prior = Network(vectors, np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(rate / (1 - rate))))
    fit, aside = np.arange(len(y)) % 5 != 0, np.arange(len(y)) % 5 == 0
    if len(set(y[fit].tolist())) < 2:
        return prior
    rng = np.random.default_rng(seed)
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z = (x[fit] - mean) / scale
    t = y[fit]
    params = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array([prior.b2])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 256):
            rows = order[at : at + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -500, 500))) - t[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if aside.any():
        logits = net.logits(x[aside])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        net.temperature = float(grid[int(np.argmin([_loss(logits / t, y[aside]) for t in grid]))])
    return net


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the doc_id as text is a multiple of 5; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Network:
    """Word vectors from all of ``docs``; a network from at most ``most_rows`` labelled documents that aren't held out.

    Of a doc_id's several labels the mean counts, a half as 1, and of its several texts
    the smallest; null labels and ids do not.
    """
    vectors = word_vectors(docs)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("doc_id is not null and quality is not null")
        .filter(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    )
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = chosen.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(as_bytes(batch.column("text")), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    # At most most_rows ids: a proven bound for the broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    table = one.mapInArrow(pooled, "doc_id long, quality int, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    width = 3 * DIMS + 2 + _CLASSES
    x = np.array([*table["x"]], dtype=np.float32).reshape(len(table), width)
    order = np.argsort(mix64(np.arange(len(table), dtype=np.uint64)), kind="stable")
    return train(x[order], table["quality"].to_numpy()[order], vectors)


def scored(docs: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """``docs`` with the network's probability of label 1 for ``text``; null and empty texts are scored as texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = network.score(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, column])
        release()

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def quality_report(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score of THRESHOLD or more) of each row of ``docs``.

    Labels of held-out documents are not read.  Rows are scored alone: repeated ones
    alike, null ids too.  An empty table gives no rows; without usable labels every
    score is a half.  Other columns are not read, and language, source, label and
    doc_id are no inputs of a score.
    """
    network = fit(docs, labels, most_rows)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), network)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_rejected(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, all columns as they are."""
    column = free("_score", docs)
    return scored(docs, fit(docs, labels, most_rows), column).filter(F.col(column) >= THRESHOLD).select(*docs.columns)
