"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is halved again and again at the median of its widest direction until
the parts have the wanted size, so lists are balanced; the means of the parts are the centroids. Every vector is put into
the list of its nearest centroid and, near a boundary, into further ones whose centroids are almost as close and lie in
other directions. A query finds its centroids by a beam search in a graph held in memory and looks into the lists
whose distances are within a ratio of the nearest.

Equal vectors are folded into one that carries its smallest ids, so a vector borne by a third of all rows is one posting.
Lists longer than a block are cut into blocks, so no task holds a list of unbounded size, and none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climagest.sources.shared import small, written

NEAREST = 5
QUERY_STEP = 50


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit, replication and pruning."""

    #: Vectors of the fitted sample, and numbers in all of them together.
    sample: int = 20_000
    sample_numbers: int = 4_000_000
    #: Distinct vectors wanted in a list, and most lists.
    list_size: int = 50
    lists: int = 4096
    #: A vector goes to at most so many lists, of centroids at most so many times as far as the nearest.
    replicas: int = 8
    replica_ratio: float = 1.25
    #: A query looks into at most so many lists, at most so many times as far as the nearest.
    probes: int = 96
    probe_ratio: float = 1.6
    links: int = 24
    beam: int = 160
    store_beam: int = 32
    #: Postings and queries that meet in one task.
    block: int = 20_000


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1, first by the largest component, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def halved(points: np.ndarray, parts: int) -> np.ndarray:
    """Means of ``parts`` or more pieces of nearly equal size."""
    pieces = [points]
    while len(pieces) < parts and max(map(len, pieces)) > 1:
        again = []
        for piece in pieces:
            if len(piece) < 2:
                again.append(piece)
                continue
            middle = piece - piece.mean(axis=0)
            direction = middle[np.argmax((middle * middle).sum(axis=1))]
            for _ in range(8):
                direction = (middle @ direction) @ middle
                direction = direction / max(np.linalg.norm(direction), 1e-300)
            order = np.argsort(middle @ direction, kind="stable")
            again += [piece[order[: len(order) // 2]], piece[order[len(order) // 2 :]]]
        pieces = again
    return np.stack([piece.mean(axis=0) for piece in pieces])


class Graph:
    """Centroids, each linked with its nearest ones, and entry points spread over them."""

    def __init__(self, centroids: np.ndarray, settings: Settings) -> None:
        self.centroids, self.settings = centroids, settings
        self.squares = (centroids * centroids).sum(axis=1)
        n = len(centroids)
        links = min(settings.links, n - 1)
        self.links = np.zeros((n, links), np.int32)
        for at in range(0, n, 512):
            far = self._far(centroids[at : at + 512], np.arange(n)[None, :])
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            self.links[at : at + 512] = np.argsort(far, axis=1, kind="stable")[:, :links]
        self.entries = np.linspace(0, n - 1, min(n, 16)).astype(np.int32)

    def _far(self, points: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances, each point to its own row of centroids (or all points to one row)."""
        if len(which) == 1:
            dots = points @ self.centroids[which[0]].T
        else:
            dots = np.einsum("bd,bkd->bk", points, self.centroids[which])
        return np.maximum((points * points).sum(axis=1)[:, None] - 2 * dots + self.squares[which], 0)

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each point that a beam search finds, nearest first, and their distances.

        All points of a batch go in step: each spreads its four nearest centroids that it has not spread yet.
        """
        rows, beam = np.arange(len(points))[:, None], min(beam, len(self.centroids))
        seen = np.zeros((len(points), len(self.centroids)), bool)
        seen[:, self.entries] = True
        pool = np.broadcast_to(self.entries, (len(points), len(self.entries)))
        far, spread = self._far(points, self.entries[None, :]), np.zeros(pool.shape, bool)
        while self.links.shape[1]:
            picked = np.argsort(np.where(spread, np.inf, far), axis=1, kind="stable")[:, :4]
            live = ~spread[rows, picked] & np.isfinite(far[rows, picked])
            if not live.any():
                break
            spread[rows, picked] = True
            around = np.sort(self.links[pool[rows, picked]].reshape(len(points), -1), axis=1)
            new = ~seen[rows, around] & np.repeat(live.any(axis=1, keepdims=True), around.shape[1], axis=1)
            new[:, 1:] &= around[:, 1:] != around[:, :-1]
            seen[rows, around] = True
            pool = np.concatenate((pool, around), axis=1)
            far = np.concatenate((far, np.where(new, self._far(points, around), np.inf)), axis=1)
            spread = np.concatenate((spread, ~new), axis=1)
            best = np.argsort(far, axis=1, kind="stable")[:, :beam]
            pool, far, spread = pool[rows, best], far[rows, best], spread[rows, best]
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        return pool[rows, order], np.sqrt(far[rows, order])

    def replicas(self, points: np.ndarray) -> list[list[int]]:
        """Lists of each point: of its nearest centroid, and of close ones that no chosen centroid is nearer to."""
        order, far = self.search(points, self.settings.store_beam)
        chosen = []
        for near, distances in zip(order, far):
            own = [int(near[0])]
            for c, distance in zip(near[1:], distances[1:]):
                if len(own) == self.settings.replicas or distance > self.settings.replica_ratio * distances[0]:
                    break
                gaps = self.centroids[own] - self.centroids[c]
                if (np.sqrt((gaps * gaps).sum(axis=1)) > 0.5 * distance).all():
                    own.append(int(c))
            chosen.append(own)
        return chosen

    def probes(self, points: np.ndarray) -> list[list[int]]:
        order, far = self.search(points, self.settings.beam)
        near = far <= self.settings.probe_ratio * far[:, :1]
        return [row[keep].tolist()[: self.settings.probes] for row, keep in zip(order, near)]


def fitted(vectors: DataFrame, settings: Settings) -> Graph:
    """A graph over the centroids of a bounded sample: the vectors whose hashes come first."""
    count, size = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    rows = max(1, min(settings.sample, settings.sample_numbers // max(1, size or 1)))
    sample = vectors.orderBy(F.xxhash64("vector"), "key").limit(rows).select("vector").toArrow()
    points = unit(matrix(sample.column("vector").combine_chunks()))
    parts = max(1, min(settings.lists, count // settings.list_size, len(points) // 4))
    return Graph(halved(points, parts), settings)


def listed(vectors: DataFrame, graph: Graph, probing: bool) -> DataFrame:
    """Each row of ``key, vector, ids`` once per list: those it is stored in, or those it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                points = unit(matrix(batch.column(1)))
                lists = graph.probes(points) if probing else graph.replicas(points)
                rows = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                numbers = pa.array(np.concatenate([np.array(x, np.int32) for x in lists]))
                yield pa.RecordBatch.from_arrays([numbers, *batch.take(rows).columns], names=["list", *batch.schema.names])

    schema = "list int, key long, vector array<double>, ids array<long>"
    return vectors.select("key", "vector", "ids").mapInArrow(run, schema)


def _nearest(k: int):
    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not len(postings) or not len(queries):
            return schema.empty_table()
        stored, asked = (unit(matrix(t.column("vector").combine_chunks())) for t in (postings, queries))
        keys = postings.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        rows, picks, scores = [], [], []
        for at in range(0, len(asked), 256):
            near = asked[at : at + 256] @ stored[order].T
            best = np.argsort(-near, axis=1, kind="stable")[:, : k + 4]
            which = np.repeat(np.arange(at, at + len(near)), best.shape[1])
            rows.append(which)
            picks.append(order[best.ravel()])
            scores.append((asked[which] * stored[picks[-1]]).sum(axis=1))
        rows, picks, scores = (np.concatenate(x) for x in (rows, picks, scores))
        return pa.Table.from_arrays(
            [
                pa.array(queries.column("key").to_numpy()[rows]),
                pa.array(keys[picks]),
                postings.column("ids").combine_chunks().take(pa.array(picks)),
                pa.array(scores),
            ],
            schema=schema,
        )

    return run


def folded(vectors: DataFrame, ids: int) -> DataFrame:
    """``key, vector, ids``: each distinct vector with its smallest ids; ``key`` is the smallest.

    Only the smallest ids of each task are shuffled.
    """
    distinct = vectors.groupBy("vector", "id").agg(F.lit(0).alias("one")).drop("one")
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = distinct.withColumn("rank", rank).where(F.col("rank") <= ids)
    groups = first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return groups.select(F.col("ids")[0].alias("key"), "vector", "ids")


def nearest(rows: DataFrame, is_query: Column, k: int = NEAREST, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, by cosine.

    ``rows`` has ``id`` and ``vector``. Null ids and vectors that are null, empty, zero or hold a null or
    non-finite component take no part, nor do vectors of another length than most have (of equally common
    lengths, the shorter). Ties go to the smaller id; the query's own id is not among its results. Repeated
    rows count once. Scores are in double precision, from the original vectors.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    rows = rows.where(F.size("vector") == (common["size"] if common else 0))
    asked = rows.where(is_query)
    vectors = written(folded(rows, k + 1), "vectors")
    empty = "query_id long, rank int, vec_id long, score double"
    if vectors.isEmpty():
        return rows.sparkSession.createDataFrame([], empty)
    graph = fitted(vectors, settings)
    queries = written(folded(asked, 1), "queries")

    postings, looks = written(listed(vectors, graph, False), "postings"), written(listed(queries, graph, True), "looks")
    cut = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("int").alias(name))
    cuts = written(cut(postings, "blocks").join(cut(looks, "turns"), "list"), "cuts")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its own kind, beside every block of the other."""
        df = df.join(small(cuts), "list").withColumn(f"{own}_no", F.pmod("key", own).cast("int"))
        return df.withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    keys = ["list", "blocks_no", "turns_no"]
    pairs = (
        dealt(postings, "blocks", "turns")
        .select(*keys, "key", "vector", "ids")
        .groupBy(*keys)
        .cogroup(dealt(looks, "turns", "blocks").select(*keys, "key", "vector").groupBy(*keys))
        .applyInArrow(_nearest(k + 1), "query long, key long, ids array<long>, score double")
    )
    once = pairs.groupBy("query", "key").agg(F.max("score").alias("score"), F.any_value("ids").alias("ids"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    best = written(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).drop("rank"), "best")

    each = asked.join(queries.select("vector", F.col("key").alias("query")), "vector")
    each = each.select(F.col("id").alias("query_id"), "query").distinct()
    hits = each.join(best, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def embedding_neighbours(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, F.col("id") % QUERY_STEP == 0)
