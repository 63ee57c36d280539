"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens.  Every partition packs its
pieces by best-fit decreasing and weighs them by two families of dual-feasible
functions, whose totals are lower bounds on the bins that any packing needs.  The
fullest bins are closed as long as their count is certified by the bound of what they
hold, to within a small share of one bin.  The pieces of open bins are exchanged -
dealt anew over fewer partitions - and packed again, until one partition holds them,
the whole count meets the bound of the whole histogram of lengths, or an exchange
saves neither a bin nor a partition.  :func:`certificate` tells what gap is left.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, groups, partitions_for, release, whole

CAPACITY = 2048
#: Pieces that one task packs at once.
PIECES = 100_000
#: A partition's closed bins exceed their bound by at most this share of a bin, all together.
WASTE = 1 / 128

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, sequence_id long, offset long, settled boolean"


# -- tokens ------------------------------------------------------------------


def _letters() -> dict[str, int]:
    """The bytes that the vocabulary's characters stand for: printable ones for themselves, the others in order from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenIds:
    """Token ids of texts, as little-endian uint32 bytes.

    White space never lies inside a token of the word vocabulary, and characters are
    lower-cased one by one, so a text's ids are those of its runs between white space.
    Runs of printable ASCII and Latin letters (U+00C0 to U+024F but dotted capital I)
    are composed already: they are split by the tokenizer's pattern and go, as lines
    of one text for many texts together, to the vocabulary's merges.  Any other run
    goes through the tokenizer itself.
    """

    #: Fixed value: the tokenizer's pattern, for the characters that :attr:`_ODD` leaves.
    _WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    _ORDINARY = "\t\n\r -~\u00c0-\u012f\u0131-\u024f"
    _SPACE = re.compile("[ \n]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([f"[^{self._ORDINARY}]", *map(re.escape, special)]))
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, letters, ranks = model.get("end_of_word_suffix") or "", _letters(), {}
        for token, number in model["vocab"].items():
            body = token.removesuffix(end) if end else token
            if all(c in letters for c in body):
                ranks.setdefault(bytes(letters[c] for c in body) + (b"\n" if end and token != body else b""), number)
        # Only if the ids are the order of the merges, and no token holds the mark of an end elsewhere, are they ranks.
        ordered = bool(end) and [model["vocab"]["".join(m)] for m in model["merges"]] == list(range(512, 512 + len(model["merges"])))
        ordered = ordered and len(ranks) == len(model["vocab"]) and not any(b"\n" in t[:-1] for t in ranks if len(t) > 2)
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self.mark = ranks.get(b"\0\n")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.merges:
            return [self._ids(t).tobytes() for t in texts]
        lines, odd, owner = [], [], []  # stretches of ordinary runs, the odd run behind each, and the text of both
        for i, text in enumerate(texts):
            at = 0
            for begin, end in self._odd_runs(text):
                lines.append(text[at:begin])
                odd.append(text[begin:end])
                owner.append(i)
                at = end
            lines.append(text[at:])
            odd.append("")
            owner.append(i)
        # A line of U+0000, which no ordinary run has, ends each stretch.
        together = "".join("\n".join(self._WORDS.findall(line.lower())) + "\n\0\n" for line in lines)
        ids = self.merges.encode_to_numpy(together).astype("<u4")
        ends = np.flatnonzero(ids == self.mark).tolist()
        out: list[list[bytes]] = [[] for _ in texts]
        for begin, end, run, i in zip([0, *(e + 1 for e in ends[:-1])], ends, odd, owner, strict=True):
            out[i].append(ids[begin:end].tobytes())
            if run:
                out[i].append(self._ids(run).tobytes())
        return [b"".join(x) for x in out]

    def _odd_runs(self, text: str) -> Iterator[tuple[int, int]]:
        """Begin and end of each run with a character beyond the ordinary ones, or with a special token."""
        at = 0
        for match in self.odd.finditer(text):
            if match.start() >= at:
                begin = max(at, 1 + max(text.rfind(" ", at, match.start()), text.rfind("\n", at, match.start())))
                space = self._SPACE.search(text, match.end())
                at = space.start() if space else len(text)
                yield begin, at

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _runs_of(text: str, size: int = 1 << 16) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut at a space, so that a very long text is never split up at once."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


_KNOWN: dict[str, TokenIds] = {}


def _encode(path: str, capacity: int):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def cut(doc: int | None, parts: list[bytes]) -> Iterator[tuple]:
        raw = b"".join([*parts, b"\0\0\0\0"])
        for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
            own = raw[at : at + 4 * capacity]
            yield doc, piece, at // 4, len(own) // 4, zlib.crc32(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _KNOWN:
            _KNOWN[path] = TokenIds(path)
        ids_of = _KNOWN[path]
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for lo, hi in groups(sizes, 1 << 20):
                texts, docs = batch.column("text").slice(lo, hi - lo).to_pylist(), batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                out: list[tuple] = []
                if hi - lo > 1:
                    for doc, own in zip(docs, ids_of.encode_all(texts), strict=True):
                        out += cut(doc, [own])
                else:  # it may be very long
                    out += cut(docs[0], [ids_of.encode(part) for part in _runs_of(texts[0])])
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)
            del batch
        release()

    return run


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: each document's ids and an id 0, cut every ``capacity`` ids.  Null text: empty.

    Ids are the tokenizer's as its file sets it up: the strings of its special tokens
    in a text are those tokens, and none is added.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(_encode(tokenizer_file, capacity), _PIECES)


# -- bounds and bins -----------------------------------------------------------


def _weights(histogram: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """Total weights of items, as (numerator, denominator) in bins; ``histogram[s]`` items have size s.

    The sum of sizes; for each threshold e up to half the capacity, the sum with sizes
    over capacity - e rounded up to a whole bin and sizes under e to nothing (the
    largest of these); and, for k up to 20, the sum with (k+1)s/capacity rounded down
    in units of 1/k, multiples kept.  Each maps sizes so that no set that fits a bin
    weighs over 1, which makes the rounded-up total a valid bound.
    """
    size = np.arange(capacity + 1)
    count = histogram[: capacity + 1].astype(np.int64)
    yield int((size * count).sum()), capacity
    number = np.cumsum(count)
    weight = np.cumsum(size * count)
    e = np.arange(1, capacity // 2 + 1)
    yield int(((number[-1] - number[capacity - e]) * capacity + weight[capacity - e] - weight[e - 1]).max(initial=0)), capacity
    for k in range(1, 21):
        exact = ((k + 1) * size) % capacity == 0
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)  # in units of 1 / (k * capacity)
        yield int((value * count).sum()), k * capacity


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that items need at least: the largest of their weights, rounded up."""
    return max(-(-n // d) for n, d in _weights(histogram, capacity))


def _closed(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int, waste: float = WASTE) -> np.ndarray:
    """Which bins stay as they are: the fullest, as long as they are at most ``waste`` of a bin more than their items weigh."""
    order = np.argsort(-fill, kind="stable")
    place = np.empty(len(fill), dtype=np.int64)
    place[order] = np.arange(len(fill))
    place = place[where]

    def wasted(bins: int) -> float:
        own = np.bincount(sizes[place < bins], minlength=capacity + 1)
        return bins - max(n / d for n, d in _weights(own, capacity))

    few, many = 0, len(fill) + 1
    if wasted(len(fill)) <= waste:
        few = len(fill)
    while many - few > 1 and few < len(fill):
        some = (few + many) // 2
        if wasted(some) <= waste:
            few = some
        else:
            many = some
    out = np.zeros(len(fill), dtype=bool)
    out[order[:few]] = True
    return out


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of items in the given order (largest first): bin and offset of each, and the fill of each bin."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    rooms = 0  # bit r: some bin has room r
    fill: list[int] = []
    where, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if room > s:
            stacks[room - s].append(b)
            rooms |= 1 << (room - s)
    return where, offset, np.array(fill, dtype=np.int64)


def _pack(turn: int, capacity: int, last: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole_part = [f for f in frames if len(f)]
        if not whole_part:
            return
        rows = pd.concat(whole_part, ignore_index=True).sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sizes = rows["length"].to_numpy()
        where, offset, fill = best_fit(sizes, capacity)
        closed = np.ones(len(fill), dtype=bool) if last else _closed(sizes, where, fill, capacity)
        task = TaskContext.get().partitionId()
        rows["sequence_id"] = (turn << 56) + (task << 32) + where
        rows["offset"] = offset
        rows["settled"] = closed[where]
        yield rows

    return run


def _histogram(rows: DataFrame, capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, dtype=np.int64)
    for row in rows.groupBy("length").count().collect():  # a row per length: at most ``capacity``
        out[row["length"]] = row["count"]
    return out


def packed(found: DataFrame, scratch: Scratch, capacity: int = CAPACITY, each: int = PIECES) -> DataFrame:
    """``found`` (the rows of :func:`pieces`) with sequence_id and offset.

    Every turn deals what is open evenly (round robin) over partitions of about
    ``each`` pieces, fewer than before, so that pieces of many partitions meet.
    """
    names = [c.split()[0] for c in _PIECES.split(", ")]
    histogram = _histogram(found, capacity)
    needed = lower_bound(histogram, capacity)
    left, parts, settled = found, partitions_for(int(histogram.sum()), each), []
    used, turn, before = 0, 0, None
    while True:
        last = turn > 0 and parts == 1
        table = scratch.keep(left.select(names).repartition(parts).mapInPandas(_pack(turn, capacity, last), _PACKED), f"packed-{turn}")
        settled.append(table.filter("settled"))
        bins, closed, still = table.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("settled"), F.col("sequence_id"))), F.count_if(~F.col("settled"))).first()
        if last or not still:
            break
        fewer = max(1, min(parts // 2, partitions_for(still, each))) if still <= parts // 2 * each else partitions_for(still, each)
        if used + bins == needed or (before and used + bins >= before[0] and fewer >= before[1]):
            settled[-1] = table  # certified as a whole, or no exchange helps any more: open bins stay as they are
            break
        before, used = (used + bins, fewer), used + closed
        left, parts, turn = table.filter("not settled"), fewer, turn + 1
    out = settled[0]
    for table in settled[1:]:
        out = out.unionByName(table)
    return out.drop("settled")


def certificate(rows: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(bins, bound): how many sequences packed ``rows`` take, and how many their lengths need at least."""
    return rows.agg(F.count_distinct("sequence_id")).first()[0], lower_bound(_histogram(rows, capacity), capacity)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` tokens: a row per piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null and empty
    texts are one token, id 0.  Longer documents are cut; no other is.  Equal lengths
    are packed in order of doc_id; repeated rows are packed each.  A null doc_id stays
    null.  An empty table gives no rows.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    return packed(scratch.keep(pieces(docs, tokenizer_file, capacity), "pieces"), scratch, capacity)
