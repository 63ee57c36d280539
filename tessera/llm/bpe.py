"""Byte-level BPE as a monoid: halves are encoded apart and joined at their border.

An encoded text is the list of its pattern matches ("pieces") and the list of its ids;
a text of at most ``leaf`` characters is encoded at once, any longer one by halves.
No id spans two pieces, so a border between pieces is one between ids.
The join of two neighbours re-encodes a window around their border only:

* Left of it, a piece that ends three characters or more before the border stands:
  no alternative of the pattern looks further than two characters past its end.
* Right of it, pieces are matched anew from there until a match ends where a piece of
  the right half begins.  Matching has no memory, so from there on both agree.  The
  window doubles until that happens, or until it holds all of the right half.

Decoding joins the ids' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import release, spread, whole

#: Characters at the leaves of the tree: a sentence or so, so that nearly every text has joins.
LEAF = 1 << 8
#: Characters right of a border in the first window.
WINDOW = 16
#: No alternative of the pattern needs more characters behind its match to be sure of it.
LOOK = 3


#: Pieces and ids.
Encoded = tuple[list[str], list[int]]


class Codec:
    """Encoder and decoder for ranks and a pattern; ``leaf`` and ``window`` only change the work, never the result."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        self.leaf, self.window = max(leaf, 4), max(window, 1)
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.width = {v: len(k) for k, v in ranks.items()}

    def encoded(self, text: str) -> Encoded:
        """Pieces and ids of ``text``, by halves."""
        if len(text) <= self.leaf:
            return self.pattern.findall(text), self.encoding.encode_ordinary(text)
        half = len(text) // 2
        return self.join(self.encoded(text[:half]), self.encoded(text[half:]))

    def cover(self, ids: Iterable[int], n: int) -> int:
        """How many of ``ids`` make up the first ``n`` bytes."""
        taken = 0
        ids = iter(ids)
        while n > 0:
            n -= self.width[next(ids)]
            taken += 1
        return taken

    def join(self, one: Encoded, two: Encoded) -> Encoded:
        """The encoded text of both; the lists of ``one`` are changed."""
        (left, ids), (right, more) = one, two
        if not left or not right:
            return one if left else two
        tail, far = [], 0
        while left and (far < LOOK or not tail):  # pieces that end within LOOK of the border, at least one
            tail.append(left.pop())
            far += len(tail[-1])
        tail = "".join(reversed(tail))
        del ids[len(ids) - self.cover(reversed(ids), len(tail.encode())) :]
        anew, k = self.meet(tail, right)
        left += anew
        left += islice(right, k, None)
        for piece in anew:
            ids += self.encoding.encode_ordinary(piece)
        ids += islice(more, self.cover(more, len("".join(right[:k]).encode())), None)
        return left, ids

    def meet(self, tail: str, right: list[str]) -> tuple[list[str], int]:
        """The pieces of ``tail`` and the text behind it up to where a match ends on a border of ``right``, and how many pieces of that they replace."""
        size = self.window
        borders: list[int] = []
        upto = taken = 0
        while True:
            while taken < len(right) and upto < size + LOOK:
                borders.append(upto)
                upto += len(right[taken])
                taken += 1
            anew, at = [], -len(tail)
            for match in self.pattern.finditer(tail + "".join(right[:taken])):
                anew.append(match.group())
                at += len(anew[-1])
                if at > upto - LOOK and taken < len(right):
                    break  # the window's end may have shaped this match
                if at >= 0:
                    k = bisect_left(borders, at)
                    if k < len(borders) and borders[k] == at:  # from here on both agree
                        return anew, k
            if taken == len(right):
                return anew, taken
            size *= 2

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``."""
        return self.encoded(text)[1]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ``ids``, by halves."""
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids) if ids else b""
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_CODECS: dict[tuple, Codec] = {}


def codec(rank_file: str, pattern: str, leaf: int = LEAF) -> Codec:
    """The codec of a rank file, read once in each Python process."""
    key = (rank_file, pattern, leaf)
    if key not in _CODECS:
        with open(rank_file, "rb") as lines:
            _CODECS[key] = Codec(read_ranks(lines), pattern, leaf)
    return _CODECS[key]


def _encoded(rank_file: str, pattern: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern, leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [c.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array<int>) of each document; a null text has none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(_encoded(rank_file, pattern, leaf), "doc_id long, ids array<int>")


def _decoded(rank_file: str, pattern: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern, leaf)
        for batch in batches:
            raw = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return run


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and raw (binary) of each row of ids; null ids give no bytes."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoded(rank_file, pattern, leaf), "doc_id long, raw binary")


def _digest(rank_file: str, pattern: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern, leaf)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = c.encode(text.as_py())
                rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        release()

    return run


def round_trip(docs: DataFrame, rank_file: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded, in one pass.

    Null and empty texts have no ids and the digest of nothing.  Rows are
    independent, so repeated ones and null ids are kept as they are; an empty table
    gives no rows.  Other columns are not read.
    """
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))).mapInArrow(_digest(rank_file, pattern, leaf), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
