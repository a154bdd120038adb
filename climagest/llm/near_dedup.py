"""Near duplicates by circulant MinHash, banding and exact verification.

Texts whose words are the same are folded into one class first, so copies cost one
grouped minimum and are never paired. Classes that share a band are linked in two steps:

1. every member of a bucket is verified against one member only, the hub, and the links found
   are joined to components. The hub is the member that meets most others over all bands, which
   is near the middle of a group of copies;
2. members of a hub that are still in different components meet in tiles. Those linked to the hub (the
   core) are one component and need not meet each other; every other member meets all members. Members are
   dealt into tiles of some 256 by their ids, and each pair of tiles is one group of a grouped map, so a task
   holds two tiles whatever the size of the group. Out of a group come rows of members, never of pairs: first
   the members that may have a link at all, then the links that join components.

A pair may be a link unless its sets' distances to the hub differ by more than 1/4 (Jaccard distance is a metric,
so they are further apart than 1/4) or 1,024 one-bit coordinates of a longer circulant signature differ in more
than 183 places, which a pair of similarity 0.75 does once in ten million. What is left is counted for all pairs of two
tiles at once, on shingle numbers, and links are confirmed on the full sets.

So a group of copies costs about one verified pair for each member. Near misses (similarity 0.64 to 0.75)
still have to be compared with all others of their group: each is sent once for every 256 members
of the group, and its pairs are bits and counts inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climagest.llm.components import components
from climagest.llm.exact_dedup import settings
from climagest.llm.shingles import Hasher, digest, mix, normal, shingle_set
from climagest.sources.shared import settled, small, written

#: 32 bands of 4 rows: a pair of similarity 0.75 shares no band once in 190,000 pairs, one of 0.8 once in 43 million.
BANDS, ROWS = 32, 4
#: Linked from this similarity, in hundredths.
LEAST = 75
BLOCK = 2048
#: One-bit coordinates, in words of 64, and how many may differ: 128 expected at 0.75, standard deviation 10.6.
BIT_WORDS, BITS_APART = 16, 183
#: Members of a tile, and bytes of their words, about.
TILE, TILE_BYTES = 256, 4 << 20
#: Shingles counted at once in a pair of tiles.
COUNTED = 4096
#: Rows that Python gets at once: a batch of whole texts is held by the JVM and by Python, in every task.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}

MEMBER = "hub long, i int, j int, tile int, doc_id long, component long, far double, bits binary"
SKETCH = "doc_id long, digest binary, n_shingles long, bands array<long>"


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of distinct shingle numbers.

    The first permutation is the mixing that made the numbers, cut to 32 bits. The second
    is one fixed bijection of the 32-bit ring; coordinate k is the smallest value after
    the ring has been shifted by k.
    """
    ring = (shingles >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(ring), BLOCK):
        x = ring[at : at + BLOCK] + shifts
        spare = np.empty_like(x)
        for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
            np.right_shift(x, shift, out=spare)
            x ^= spare
            x *= np.uint32(factor)
        np.right_shift(x, 15, out=spare)
        x ^= spare
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band, different in each band."""
    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return keys.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        ids, digests, sizes, keys = batch.column(0), [], [], []
        for value in batch.column(1):
            norm = normal(value.as_py())
            shingles = np.unique(hasher.shingles(hasher.words(norm)))
            sizes.append(len(shingles))
            digests.append(digest(norm) if norm else None)
            keys.append(band_keys(signature(shingles)) if norm else np.empty(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(digests, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else [], pa.int64())),
            ],
            names=["doc_id", "digest", "n_shingles", "bands"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: digest of its words (null without words), number of distinct shingles and band keys."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_sketches, SKETCH)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, set()
    for batch in batches:
        a, b, text_a, text_b = (batch.column(i) for i in range(4))
        shares = []
        for i in range(batch.num_rows):
            if (now := text_a[i].as_py()) != last:
                last, held = now, shingle_set(now)
            other = shingle_set(text_b[i].as_py())
            common = len(held & other)
            shares.append((common, len(held) + len(other) - common))
        common, whole = (pa.array([s[i] for s in shares], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([a, b, common, whole], names=["a", "b", "common", "whole"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        norms = [normal(value.as_py()) for value in batch.column(1)]
        signatures = (signature(hasher.shingles(hasher.words(norm)), 64 * BIT_WORDS) for norm in norms)
        bits = [np.packbits((s & 1).astype(bool)).tobytes() for s in signatures]
        columns = [batch.column(0), pa.array(norms, pa.binary()), pa.array(bits, pa.binary())]
        sizes = pa.array([len(norm) for norm in norms], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, sizes], names=["doc_id", "norm", "bits", "size"])


def candidates(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Words and one-bit signatures of the documents that pairs name; no other text is kept or moved.

    Of rows that share an id the smallest text counts.
    """
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(small(written(named, "named")), "doc_id", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    return written(rows.mapInArrow(_candidates, "doc_id long, norm binary, bits binary, size long"), "candidates")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Sizes of intersection and union of the full shingle sets of ``(a, b)`` pairs of ids."""
    texts = texts.select("doc_id", "norm")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long, common long, whole long")


def linked(compared: DataFrame) -> DataFrame:
    return compared.where(100 * F.col("common") >= LEAST * F.col("whole"))


def near_links(sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """``(u, v)``: document and smallest document of its component, for the classes that are not the smallest."""
    first = sketched.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    rows = sketched.join(first, ["digest", "doc_id"], "left_semi")
    keyed = rows.select("doc_id", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, "key"), "shared")
    central = shared.groupBy("doc_id").agg(F.sum("n").alias("central"))
    ranked = shared.join(central, "doc_id").select("key", "doc_id", F.struct("central", (-F.col("doc_id")).alias("id")).alias("rank"))
    hubs = ranked.groupBy("key").agg((-F.max("rank")["id"]).alias("hub"))
    members = written(shared.join(hubs, "key").select("key", "hub", "doc_id").distinct(), "buckets")

    stars = written(members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    texts = candidates(stars, docs)
    tested = written(compare(stars, texts), "tested")
    joined = components(linked(tested).select(F.col("a").alias("u"), F.col("b").alias("v")))
    near = written(meetings(tested, joined, texts).groupBy("hub", "i", "j").applyInArrow(_may_link, MEMBER), "near")
    found = written(tile_links(near, texts), "found")
    return joined if found.isEmpty() else components(found.union(joined))


def placed_in(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``members`` with the component each is in so far."""
    of = small(joined).select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
    return members.join(of, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def meetings(tested: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """Members of hubs that are not all in one component, once for each pair of tiles in which they meet others.

    The tiles from 0 on hold the members that are not linked to the hub, the last ones its core.
    """
    far = (1 - F.col("common") / F.col("whole")).alias("far")
    core = (100 * F.col("common") >= LEAST * F.col("whole")).alias("core")
    members = placed_in(tested.select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), far, core), joined)
    members = written(members.join(texts.select("doc_id", "bits", "size"), "doc_id"), "members")

    def tiles(of: Column) -> Column:
        rows, size = F.count(F.when(of, 1)), F.coalesce(F.sum(F.when(of, F.col("size"))), F.lit(0))
        return F.ceil(F.greatest(rows / TILE, size / TILE_BYTES)).cast("int")

    spans = members.groupBy("hub").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        tiles(~F.col("core")).alias("others"),
        tiles(F.col("core")).alias("cores"),
    )
    mixed = members.join(small(written(spans.where("x <> y").select("hub", "others", "cores"), "mixed")), "hub")
    own = F.xxhash64("doc_id")
    tile = F.when(F.col("core"), F.col("others") + F.pmod(own, F.col("cores"))).otherwise(F.pmod(own, F.col("others"))).cast("int")
    # the core meets the others only
    last = F.col("others") - 1 + F.when(F.col("core"), 0).otherwise(F.col("cores"))
    met = mixed.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    i, j = F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")
    return met.select("hub", i, j, "tile", "doc_id", "component", "far", "bits")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of both tiles, and which pairs between them may be links that join components."""
    tile, component, far = (table.column(name).to_numpy() for name in ("tile", "component", "far"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BIT_WORDS)
    left, right = (np.flatnonzero(tile == table.column(name)[0].as_py()) for name in ("i", "j"))
    apart = np.zeros((len(left), len(right)), np.uint16)
    for word in range(BIT_WORDS):
        apart += np.bitwise_count(bits[left, word][:, None] ^ bits[right, word])
    near = np.abs(far[left][:, None] - far[right]) <= (100 - LEAST) / 100 + 1e-9
    return left, right, (apart <= BITS_APART) & near & (component[left][:, None] != component[right])


def _may_link(table: pa.Table) -> pa.Table:
    """The members of a pair of tiles that may have a link to another component."""
    left, right, close = _sides(table)
    return table.take(np.union1d(left[close.any(axis=1)], right[close.any(axis=0)]))


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right; a set is an array of distinct numbers."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    counts = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for sets in (left, right):
        numbers, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        places = np.minimum(np.searchsorted(both, numbers), max(0, len(both) - 1))
        held = np.flatnonzero(both[places] == numbers) if len(both) else places[:0]
        held = held[np.argsort(places[held], kind="stable")]
        sides.append((len(sets), rows[held], places[held]))
    for start in range(0, len(both), COUNTED):
        part = []
        for n, rows, places in sides:
            a, b = np.searchsorted(places, (start, start + COUNTED))
            holds = np.zeros((n, min(COUNTED, len(both) - start)), np.float32)
            holds[rows[a:b], places[a:b] - start] = 1
            part.append(holds)
        counts += (part[0] @ part[1].T).astype(np.int64)
    return counts


def _linker() -> Callable[[pa.Table], pa.Table]:
    hasher = Hasher()

    def links(table: pa.Table) -> pa.Table:
        """Links between the two tiles, only those that join components."""
        left, right, close = _sides(table)
        ids, component, norms = (table.column(name).to_pylist() for name in ("doc_id", "component", "norm"))
        sets = [np.unique(hasher.shingles(hasher.words(norm))) for norm in norms]
        sizes = np.array([len(s) for s in sets])
        found, root = [], {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        if close.any():
            common = common_counts([sets[k] for k in left], [sets[k] for k in right])
            whole = sizes[left][:, None] + sizes[right] - common
            for x, y in np.argwhere(close & (100 * common >= LEAST * whole)):
                x, y = left[x], right[y]
                u, v = top(component[x]), top(component[y])
                if u != v:
                    a, b = shingle_set(norms[x]), shingle_set(norms[y])
                    if 100 * len(a & b) >= LEAST * len(a | b):
                        root[u] = v
                        found.append((ids[x], ids[y]))
        u, v = (pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1))
        return pa.table({"u": u, "v": v})

    return links


def tile_links(near: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that join components, at most one for each member of a pair of tiles."""
    rows = near.join(texts.select("doc_id", "norm"), "doc_id")
    return rows.groupBy("hub", "i", "j").applyInArrow(_linker(), "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (columns ``doc_id`` and ``text``).

    Two rows are linked when 100 times the common shingles reach 75 times all shingles of
    both. ``component_id`` is the smallest ``doc_id`` reachable; ``kept`` marks the row that
    bears it. Texts that are null or have no words are linked with nothing and kept. Rows that share
    an id count as one document (each gets a row; all are kept or none). Rows without an id
    take the component of a copy that has one; otherwise they stay alone, with a null component, kept.
    """
    with settings(docs.sparkSession, BATCHES):
        sketched = written(sketches(docs), "sketches")
        roots = near_links(sketched.where("doc_id is not null"), docs)
    classes = sketched.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    known = classes.join(roots.toDF("first", "root"), "first", "left").where("n > 1 or root is not null")
    known = written(known.select("digest", F.coalesce("root", "first").alias("component")), "classes")
    rows = sketched.select("doc_id", "digest", "n_shingles").join(small(known), "digest", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns.

    Repeated rows of the id that stays are all kept; null texts and rows without an id
    that are nobody's copy stay.
    """
    gone = settled(docs.sparkSession, lambda: near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    without = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return without.join(small(gone), "doc_id", "left_anti").select(*(f"`{name}`" for name in docs.columns))
