"""Approximate search, only where asked for: an inverted file of coarse cells, and small-world graphs a partition each.

The inverted file's cells are fitted on a bounded sample and every row is assigned to
one; a query scans its nearest cells.  Graphs are built in a task for each shard and
searched there, and the shards' best are merged: the way to serve many queries
against shards that are kept.  :func:`recall` measures either against exact search.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.scalars import shard_ef
from tessera.operators.pq import lloyd
from tessera.operators.search import top

#: Rows that cells are fitted on at most: those with the smallest hashes of the id.
SAMPLE = 50_000
#: Links of a node above and on the ground layer, and the beam while building.
LINKS, GROUND_LINKS, BUILD_BEAM = 16, 32, 100


# -- inverted file -------------------------------------------------------------


def fit_cells(rows: DataFrame, cells: int, key: str = "vector_id", vector: str = "vector", sample: int = SAMPLE) -> np.ndarray:
    """Centroids (cells x dim) from at most ``sample`` rows."""
    own = rows.select(key, vector).orderBy(F.xxhash64(key), key).limit(sample).toPandas().sort_values(key)
    points = np.array([*own[vector]], dtype=np.float64)
    return lloyd(points, min(cells, len(points)))


def assign_cells(rows: DataFrame, centroids: np.ndarray, vector: str = "vector") -> DataFrame:
    """``rows`` with cell: the nearest centroid of each.  Written partitioned by cell, a search reads only its cells."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        points = np.array([*vectors], dtype=np.float64)
        far = (centroids * centroids).sum(axis=1) - 2 * points @ centroids.T
        return pd.Series(far.argmin(axis=1).astype(np.int32))

    return rows.withColumn("cell", nearest(vector))


def probe(centroids: np.ndarray, query: Sequence[float], probes: int) -> list[int]:
    """The cells nearest the query."""
    far = ((centroids - np.asarray(query, dtype=np.float64)) ** 2).sum(axis=1)
    return np.argsort(far, kind="stable")[:probes].tolist()


def ivf_topk(index: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int, probes: int = 8, key: str = "vector_id", vector: str = "vector") -> DataFrame:
    own = index.filter(F.col("cell").isin(probe(centroids, query, probes)))
    return top(own.select(key, V.dot(vector, V.vector(query)).alias("score")), k, key).select("rank", key, "score")


def ivf_batch(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int = 8, key: str = "vector_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, key, score): each query meets the rows of its cells by an equi-join on the cell."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        points = np.array([*vectors], dtype=np.float64)
        far = (centroids * centroids).sum(axis=1) - 2 * points @ centroids.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    wanted = queries.select("query_id", F.col("query").alias("_query"), F.explode(cells("query")).alias("cell"))
    scored = index.join(wanted, "cell").select("query_id", key, V.dot(vector, "_query").alias("score"))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


# -- small-world graphs --------------------------------------------------------


class Graph:
    """A navigable small world over the rows of one shard; similarity is the inner product."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, ground: int = GROUND_LINKS, beam: int = BUILD_BEAM, seed: int = 42):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        self.most = lambda layer: ground if layer == 0 else links
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / np.log(links)).astype(int)
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
        self.entry = -1
        self.top = -1
        for node, level in enumerate(levels.tolist()):
            self._insert(node, level, beam, links)

    def _scores(self, query: np.ndarray, nodes: list[int]) -> np.ndarray:
        return self.vectors[nodes] @ query

    def _beam(self, query: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` best nodes that a best-first walk from ``starts`` meets, best first."""
        seen = {n for _, n in starts}
        front = [(-s, n) for s, n in starts]
        found = list(starts)
        heapq.heapify(front)
        heapq.heapify(found)
        links = self.layers[layer]
        while front:
            score, node = heapq.heappop(front)
            if len(found) >= width and -score < found[0][0]:
                break
            new = [n for n in links.get(node, ()) if n not in seen]
            if not new:
                continue
            seen.update(new)
            for s, n in zip(self._scores(query, new).tolist(), new, strict=True):
                if len(found) < width or s > found[0][0]:
                    heapq.heappush(front, (-s, n))
                    heapq.heappush(found, (s, n))
                    if len(found) > width:
                        heapq.heappop(found)
        return sorted(found, reverse=True)

    def _spread(self, ranked: list[tuple[float, int]], most: int) -> list[int]:
        """Links that are nearer to the node than to a link before; then the best of the rest."""
        chosen: list[int] = []
        for s, n in ranked:
            if len(chosen) == most:
                return chosen
            if not chosen or float(self._scores(self.vectors[n], chosen).max()) < s:
                chosen.append(n)
        return chosen + [n for _, n in ranked if n not in chosen][: most - len(chosen)]

    def _insert(self, node: int, level: int, beam: int, links: int) -> None:
        query = self.vectors[node]
        if self.entry >= 0:
            near = [(float(self.vectors[self.entry] @ query), self.entry)]
            for layer in range(self.top, level, -1):
                near = self._beam(query, near[:1], 1, layer)
            for layer in range(min(level, self.top), -1, -1):
                near = self._beam(query, near, beam, layer)
                chosen = self._spread(near, links)
                self.layers[layer][node] = chosen
                for other in chosen:
                    back = self.layers[layer].setdefault(other, [])
                    back.append(node)
                    if len(back) > self.most(layer):
                        ranked = sorted(zip(self._scores(self.vectors[other], back).tolist(), back, strict=True), reverse=True)
                        self.layers[layer][other] = self._spread(ranked, self.most(layer))
        for layer in range(level + 1):
            self.layers[layer].setdefault(node, [])
        if level > self.top:
            self.top, self.entry = level, node

    def search(self, query: Sequence[float], k: int, beam: int, allowed: Callable[[int], bool] | None = None) -> list[tuple[int, float]]:
        """(row, score), best first.  With ``allowed`` the beam widens, and what is not allowed is left out at the end."""
        if self.entry < 0 or k == 0:
            return []
        q = np.asarray(query, dtype=np.float32)
        near = [(float(self.vectors[self.entry] @ q), self.entry)]
        for layer in range(self.top, 0, -1):
            near = self._beam(q, near[:1], 1, layer)
        width = max(beam, k) if allowed is None else max(2 * beam, 4 * k)
        found = self._beam(q, near, width, 0)
        return [(n, s) for s, n in found if allowed is None or allowed(n)][:k]


# Allowed rows up to which a scan is exact, always or as a share of all; widenings of the beam, and of the last, unfiltered search.
SCAN, SCAN_MOST, SCAN_SHARE = 5_000, 50_000, 0.05
WIDER = {2: ((8, 16, 32), 64), 8: ((4, 8, 16), 32), None: ((2, 4, 8), 32)}


def beams(allowed: int, rows: int, ef: int, k: int) -> list[int] | None:
    """None for an exact scan (few rows are allowed), else the beams to try in turn, wider the fewer rows are allowed for each of the k."""
    if allowed <= SCAN or (allowed <= SCAN_MOST and allowed <= SCAN_SHARE * rows):
        return None
    factors, _ = next(v for times, v in WIDER.items() if times is None or allowed <= times * k)
    return [max(ef, k), *(max(ef, k) * f for f in factors)]


def filtered_search(graph: "Graph", query: Sequence[float], k: int, ef: int, allowed: set[int]) -> list[tuple[int, float]]:
    """(row, score) of the k best allowed rows: an exact scan for few; else ever wider beams, and at last an unfiltered search that is filtered then."""
    rows = len(graph.vectors)
    target = min(k, len(allowed))
    widths = beams(len(allowed), rows, ef, k)
    if widths is None:
        some = np.array(sorted(a for a in allowed if a < rows), dtype=np.int64)
        scores = graph.vectors[some] @ np.asarray(query, dtype=np.float32)
        return [(int(some[i]), float(scores[i])) for i in np.lexsort((some, -scores))[:k]]
    best: list[tuple[int, float]] = []
    for width in widths:
        found = graph.search(query, k, width, allowed.__contains__)
        best = max(best, found, key=len)
        if len(best) >= target:
            return best
    _, times = next(v for most, v in WIDER.items() if most is None or len(allowed) <= most * k)
    many = min(max(k, target) * times, 4096, max(rows, k))
    routed = [x for x in graph.search(query, many, min(2 * max(ef, many), 8192)) if x[0] in allowed][:k]
    return max(best, routed, key=len)


def graph_topk(rows: DataFrame, queries: DataFrame, k: int, ef: int = 50, shards: int = 8, key: str = "vector_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, key, score): a graph in a task for each shard, the shards' best merged.  A row's shard is its id modulo ``shards``.

    The query block is sent to every shard: keep it to a few megabytes and call again for more.
    """
    own = queries.select("query_id", "query").toPandas()
    ids, matrix = own["query_id"].tolist(), [np.asarray(q) for q in own["query"]]
    beam = shard_ef(ef, k, shards)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        keys = frame[key].to_numpy()
        graph = Graph(np.array([*frame[vector]]))
        found = [(q, int(keys[n]), float(s)) for q, v in zip(ids, matrix, strict=True) for n, s in graph.search(v, k, beam)]
        return pd.DataFrame(found, columns=["query_id", key, "score"])

    parts = rows.select(F.col(key).cast("long").alias(key), vector).groupBy(F.pmod(F.col(key), F.lit(shards)).alias("shard")).applyInPandas(run, f"query_id long, {key} long, score double")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return parts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def graph_table(vectors: DataFrame, key: str = "vector_id", vector: str = "vector", shards: int = 1) -> DataFrame:
    """(shard, node_id, layer, neighbors): the shards' graphs as rows, node numbers by ascending id."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        keys = frame[key].tolist()
        graph = Graph(np.array([*frame[vector]]))
        shard = int(keys[0]) % shards
        return pd.DataFrame([(shard, keys[n], layer, [keys[m] for m in own]) for layer, nodes in enumerate(graph.layers) for n, own in sorted(nodes.items())], columns=["shard", "node_id", "layer", "neighbors"])

    return vectors.select(F.col(key).cast("long").alias(key), vector).groupBy(F.pmod(F.col(key), F.lit(shards)).alias("_shard")).applyInPandas(run, "shard int, node_id long, layer int, neighbors array<long>")


def graph_stats(graph: DataFrame) -> DataFrame:
    """(layer, nodes, edges)."""
    return graph.groupBy("layer").agg(F.count("*").alias("nodes"), F.sum(F.size("neighbors")).cast("long").alias("edges"))


def recall(found: DataFrame, exact: DataFrame, key: str = "vector_id") -> float:
    """Share of exact results (query_id, key) that ``found`` has."""
    total = exact.count()
    return found.join(exact, ["query_id", key], "left_semi").count() / total if total else 1.0
