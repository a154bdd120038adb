"""Alignment of two tokenizers, and in how many documents each pair of their tokens is linked.

Both tokenizers begin anew at a single space between two other signs, so a text is a sequence of
units, each with the space before it, whose tokens and links depend on the unit alone. Texts are encoded once and
stored in chunks: the tokens of the distinct units of some texts, and the units of each text. Every pass aligns
the distinct units of a chunk and adds up what it knows of them text by text.

First pass: the distinct linked pairs are gathered, and a minimal perfect hash function is built
of them, block by block on the executors (buckets of about three pairs, displaced until no two pairs meet).
It numbers the pairs without gaps, so each task counts documents in one dense vector; the vectors
are summed in a tree. Each place of the function holds its pair, against which every lookup is verified.
Second pass: the texts are aligned again and their links looked up. Functions beyond the broadcast
limit are handed out in ranges of blocks, one after the other.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climagest.llm.shingles import mix
from climagest.sources.shared import broadcast_limit, fresh_path, written

#: Where both tokenizers begin anew: one space, with something else than white space on both sides.
CUT = re.compile(r"(?<=\S) (?=[\w!-/:-@\[-`{-~])")
SPACE = "▁"
UNITS_KNOWN = 100_000  # units remembered in a task; beyond that it starts anew
SIGNS_KNOWN = 4 << 20  # and signs in them
SIGNS = 1 << 20  # signs of texts in a chunk
# ---- fixed values: the split pattern of byte-level tokenizers, and the setting that stands for it
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
# ----
BLOCK = 8192  # pairs in a block of the function, on average
PER_BUCKET = 3
PAIR_BYTES = 20  # of a pair in the function, with its count
FAN = 16  # vectors summed together in the tree
TRIES = 64
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

PARTS = ("bounds", "codes", "n_of_a", "ids_a", "n_of_b", "ids_b")
TOTALS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


# ---- units


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 signs are themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, first: str, second: bytes) -> None:
        import sentencepiece

        letters = byte_letters()
        model = json.loads(first)
        vocabulary = model["model"]["vocab"]
        self.size_a = max([*vocabulary.values(), *(token["id"] for token in model["added_tokens"])]) + 1
        self.bytes_a = [b""] * self.size_a
        special = {token["content"] for token in model["added_tokens"]}
        for token, number in vocabulary.items():
            if token not in special:
                self.bytes_a[number] = bytes(letters[sign] for sign in token)
        self.first = self._byte_level(first, model)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [
            bytes([int(name[3:5], 16)]) if self.second.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)
        ]
        self.splits = not any(SPACE in name.lstrip(SPACE) for name in names)
        self.sizes = self.size_a, len(self.bytes_b)
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b)]

    def _byte_level(self, first: str, model: dict) -> Callable:
        """Encodes many texts. Where the numbers of the tokens follow the order of the merges, ranks say the same
        as the list of merges, and the quicker library is used."""
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        made = [model["model"]["vocab"][token] for token in merges]
        if made == sorted(made) and model["pre_tokenizer"] == BYTE_LEVEL and not model["normalizer"]:
            import tiktoken

            ranks = {token: number for number, token in enumerate(self.bytes_a) if token}
            quick = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: list(map(quick.encode_ordinary, texts))
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        slow = tokenizers.Tokenizer.from_str(first)
        slow.encode_special_tokens = True  # their strings are plain text
        return lambda texts: [found.ids for found in slow.encode_batch(texts, add_special_tokens=False)]

    def units(self, text: str) -> list[str]:
        return CUT.split(text) if self.splits else [text]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of each unit behind a space, and no tokens where either side's bytes are not those of the unit."""
        spaced = [" " + unit for unit in units]
        a, b = self.first(spaced), self.second.encode(units, num_threads=1)
        for table, found in ((self.bytes_a, a), (self.bytes_b, b)):
            joined = [b"".join([table[i] for i in ids]) for ids in found]
            if joined != (wanted := [unit.encode() for unit in spaced]):
                for k in range(len(units)):
                    if joined[k] != wanted[k]:
                        a[k], b[k] = [], []
        return a, b


@functools.lru_cache(maxsize=1)
def tokenizers_of(first: str, second: bytes) -> Tokenizers:
    """One per worker process and pair of vocabularies."""
    return Tokenizers(first, second)


@dataclass
class Links:
    """Alignment of texts laid end to end: pairs, whose A token each belongs to, and which tokens end a group."""

    a_of: np.ndarray
    b_of: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def link(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Links:
    """Links tokens whose bytes overlap, given the lengths of two ways of cutting the same bytes."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    first = np.searchsorted(ends_b, ends_a - lengths_a, side="right")
    last = np.searchsorted(ends_b, ends_a, side="left")
    many = last - first + 1
    a_of = np.repeat(np.arange(len(ends_a)), many)
    b_of = np.arange(len(a_of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    cut_b = np.zeros(len(ends_b), bool)
    cut_a = ends_b[last] == ends_a
    cut_b[last[cut_a]] = True
    return Links(a_of, b_of, cut_a, cut_b)


class Units(dict):
    """The units met in a task, numbered, with their tokens."""

    def __init__(self, tools: Tokenizers) -> None:
        self.tools = tools
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.signs = 0
        self.ids = [np.empty(0, np.uint32), np.empty(0, np.uint32)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number

    def full(self) -> bool:
        return len(self) > UNITS_KNOWN or self.signs > SIGNS_KNOWN

    def chunk(self, texts: list[str]) -> tuple[bytes, ...]:
        """Of each text its units, and of the distinct units the numbers of tokens and the tokens: bounds, codes, and both twice."""
        lists = [list(map(self.__getitem__, self.tools.units(text))) if text else [] for text in texts]
        bounds = np.cumsum([0, *map(len, lists)])
        codes = np.fromiter(itertools.chain.from_iterable(lists), np.int64, bounds[-1])
        if self.new:
            self._learn()
        known, codes = np.unique(codes, return_inverse=True)
        packed = [narrow(bounds), narrow(codes)]
        for ids, starts in zip(self.ids, self.starts):
            many = starts[known + 1] - starts[known]
            packed += [narrow(many), narrow(ids[spread(starts[known], many)])]
        return tuple(packed)

    def _learn(self) -> None:
        self.signs += sum(map(len, self.new))
        for k, side in enumerate(self.tools.encode(self.new)):
            many = np.cumsum([len(ids) for ids in side])
            self.starts[k] = np.concatenate((self.starts[k], self.starts[k][-1] + many))
            ids = np.fromiter(itertools.chain.from_iterable(side), np.uint32, many[-1])
            self.ids[k] = np.concatenate((self.ids[k], ids))
        self.new = []


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, behind the number of bytes."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def wide(packed: memoryview) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def spread(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places ``start``, ``start + 1`` ... of each run, one run after the other."""
    return np.arange(int(many.sum())) + np.repeat(starts - np.cumsum(many) + many, many)


class Chunk:
    """Some texts as units, and the alignment of their distinct units."""

    def __init__(self, size_b: int, lengths: list[np.ndarray], parts: list[memoryview]) -> None:
        self.bounds, self.codes, self.n_a, self.a, self.n_b, self.b = map(wide, parts)
        self.units = len(self.n_a)
        self.unit_a, self.unit_b = (np.repeat(np.arange(self.units), n) for n in (self.n_a, self.n_b))
        self.met = link(lengths[0][self.a], lengths[1][self.b])
        self.many = np.bincount(self.unit_a[self.met.a_of], minlength=self.units)
        self.starts = np.concatenate(([0], np.cumsum(self.many)))
        # the distinct pairs of the chunk, and for each link which of them it is
        self.pairs, self.links = np.unique(self.a[self.met.a_of] * size_b + self.b[self.met.b_of], return_inverse=True)
        # a unit without tokens is not given back whole
        self.whole = self.by_text(self.n_a == 0) == 0

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the units of each text of a value per unit."""
        return _sums(values[self.codes].astype(np.int64), self.bounds)

    def by_unit(self, values: np.ndarray) -> np.ndarray:
        """Sums over the links of each unit of a value per pair."""
        return _sums(values[self.links], self.starts)

    def documents(self) -> np.ndarray:
        """In how many whole texts each pair is linked."""
        text = np.repeat(np.arange(len(self.whole)), np.diff(self.bounds))
        kept = self.whole[text]
        text, unit = np.divmod(np.unique(text[kept] * max(1, self.units) + self.codes[kept]), max(1, self.units))
        pairs = max(1, len(self.pairs))
        linked = self.links[spread(self.starts[unit], self.many[unit])]
        once = np.unique(np.repeat(text, self.many[unit]) * pairs + linked)
        return np.bincount(once % pairs, minlength=len(self.pairs))

    def groups(self) -> list[str]:
        """The groups of each text: A ids, a bar, B ids, and a semicolon between groups."""
        cuts = self.met.cut_a, self.met.cut_b
        group = [np.cumsum(cut) - cut for cut in cuts]
        order = np.argsort(np.concatenate((2 * group[0], 2 * group[1] + 1)), kind="stable")
        marks = np.concatenate((np.where(cuts[0], "|", ","), np.where(cuts[1], ";", ",")))[order].tolist()
        parts = list(map(str.__add__, map(str, np.concatenate((self.a, self.b))[order].tolist()), marks))
        at = np.searchsorted(np.concatenate((self.unit_a, self.unit_b))[order], np.arange(self.units + 1)).tolist()
        units = ["".join(parts[i:j]) for i, j in zip(at, at[1:])]
        codes, bounds = self.codes.tolist(), self.bounds.tolist()
        texts = zip(self.whole.tolist(), bounds, bounds[1:])
        return ["".join([units[k] for k in codes[i:j]])[:-1] if ok else "" for ok, i, j in texts]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(values)))
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _chunks(sent) -> Callable:
    """Rows and texts to chunks of bounded size; a longer text is a chunk of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(tokenizers_of(*sent.value))

        def packed(rows: pa.Array, texts: list[str]) -> pa.RecordBatch:
            parts = units.chunk(texts)
            if units.full():
                units.forget()
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([listed, *(pa.array([x], pa.binary()) for x in parts)], names=["rows", *PARTS])

        for batch in batches:
            rows, begin, held, signs = batch.column(0), 0, [], 0
            for row, value in enumerate(batch.column(1)):
                held.append((value.as_py() or b"").decode("utf-8", "replace"))
                signs += len(held[-1])
                if signs >= SIGNS:
                    yield packed(pa.concat_arrays([rows.slice(begin, len(held))]), held)
                    begin, held, signs = row + 1, [], 0
            if held:
                yield packed(pa.concat_arrays([rows.slice(begin, len(held))]), held)

    return run


def _aligned_chunks(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Chunk]]:
    """The chunks of a task with the batch and row they stand in."""
    sizes, lengths = sent.value
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch, row, Chunk(sizes[1], lengths, [memoryview(batch.column(name)[row].as_buffer()) for name in PARTS])


# ---- the function


def _bucket(keys: np.ndarray, buckets: np.ndarray | int) -> np.ndarray:
    return mix(keys + _OTHER) % np.asarray(buckets).astype(np.uint64)


def _slot(keys: np.ndarray, shift: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return mix(keys ^ mix(shift.astype(np.uint64) * _STEP + _OTHER)) % np.asarray(size).astype(np.uint64)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def buckets_of(size: np.ndarray | int) -> np.ndarray | int:
    return np.maximum(1, size // PER_BUCKET)


def displaced(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash function of distinct keys: the shift of each bucket, and the keys in their slots.

    Larger buckets are placed first, by trying shifts until all their keys fall on free slots. A bucket of one
    key takes any slot that is left; its shift is then minus the slot, less one.
    """
    size = len(keys)
    keys = keys.astype(np.uint64)
    buckets = _bucket(keys, buckets_of(size)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    counts = np.bincount(buckets, minlength=int(buckets_of(size)))
    ends = np.cumsum(counts)
    shifts = np.zeros(len(counts), np.int32)
    free = np.ones(size, bool)
    slots = np.empty(size, np.uint64)
    for bucket in np.argsort(-counts, kind="stable"):
        many = counts[bucket]
        if many < 2:
            break
        mine = order[ends[bucket] - many : ends[bucket]]
        begin = 0
        while True:
            tried = _slot(keys[mine][None, :], np.arange(begin, begin + TRIES)[:, None], size)
            fits = free[tried].all(axis=1)
            if fits.any():
                spread = np.sort(tried[fits], axis=1)
                apart = (spread[:, 1:] != spread[:, :-1]).all(axis=1)
                if apart.any():
                    found = np.flatnonzero(fits)[np.argmax(apart)]
                    break
            begin += TRIES
        shifts[bucket] = begin + found
        slots[mine] = tried[found]
        free[tried[found]] = False
    left = np.flatnonzero(free)
    alone = np.flatnonzero(counts == 1)
    shifts[alone] = -1 - left
    slots[order[ends[alone] - 1]] = left
    placed = np.empty(size, np.int64)
    placed[slots.astype(np.int64)] = keys.astype(np.int64)
    return shifts, placed


class Function:
    """Numbers the pairs of a range of blocks without gaps."""

    def __init__(self, blocks: int, low: int, rows: list[tuple[int, bytes, bytes]]) -> None:
        """``rows``: of every block from ``low`` on its number, shifts and keys; blocks without pairs have no row."""
        self.blocks, self.low = blocks, low
        self.high = max((block for block, _, _ in rows), default=low - 1) + 1
        found = {block: (np.frombuffer(s, "<i4"), np.frombuffer(k, "<i8")) for block, s, k in rows}
        empty = np.empty(0, np.int32), np.empty(0, np.int64)
        parts = [found.get(block, empty) for block in range(low, self.high)]
        self.shifts = np.concatenate([s for s, _ in parts] or [empty[0]])
        self.keys = np.concatenate([k for _, k in parts] or [empty[1]])
        self.shift_starts = np.concatenate(([0], np.cumsum([len(s) for s, _ in parts]))).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum([len(k) for _, k in parts]))).astype(np.int64)

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs belong to the range, and the numbers of those. A pair that was never counted is an error."""
        blocks = block_of(pairs, self.blocks)
        here = np.flatnonzero((blocks >= self.low) & (blocks < self.high))
        keys, block = pairs[here].astype(np.uint64), blocks[here] - self.low
        size = self.starts[block + 1] - self.starts[block]
        if (size == 0).any():
            raise ValueError("a pair was not counted")
        shift = self.shifts[self.shift_starts[block] + _bucket(keys, buckets_of(size)).astype(np.int64)].astype(np.int64)
        slot = np.where(shift < 0, -1 - shift, _slot(keys, np.maximum(shift, 0), size).astype(np.int64))
        found = self.starts[block] + slot
        if (self.keys[found] != pairs[here]).any():
            raise ValueError("a pair was not counted")
        return here, found


# ---- passes


def _pairs(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk in _aligned_chunks(sent, batches):
            yield pa.RecordBatch.from_arrays([pa.array(chunk.pairs, pa.int64())], names=["pair"])

    return run


def _in_blocks(blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = block_of(batch.column(0).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(0)], names=["block", "pair"])

    return run


def _build(pairs: pa.Table) -> pa.Table:
    """The function of one block; the order in which its pairs arrive makes no difference."""
    shifts, keys = displaced(np.sort(pairs.column("pair").to_numpy()))
    rows = [pairs.column("block")[0].as_py()], [shifts.astype("<i4").tobytes()], [keys.astype("<i8").tobytes()]
    return pa.table({"block": pa.array(rows[0], pa.int64()), "shifts": pa.array(rows[1], pa.binary()), "pairs": pa.array(rows[2], pa.binary())})


def _vectors(sent, numbered) -> Callable:
    """In how many texts of a task each pair is linked, one dense vector, cut at the blocks of the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = numbered.value
        vector = np.zeros(len(function.keys), np.int64)
        for _, _, chunk in _aligned_chunks(sent, batches):
            here, found = function(chunk.pairs)
            vector[found] += chunk.documents()[here]
        part = TaskContext.get().partitionId()
        for block, (i, j) in enumerate(zip(function.starts, function.starts[1:]), function.low):
            if vector[i:j].any():
                packed = vector[i:j].astype("<i8").tobytes()
                row = [pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.array([packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["block", "part", "counts"])

    return run


def _add_vectors(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("counts"))
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int64()),
            "part": pa.array([key[1].as_py()], pa.int64()),
            "counts": pa.array([total.astype("<i8").tobytes()], pa.binary()),
        }
    )


def tree_sum(vectors: DataFrame) -> DataFrame:
    """One vector per block. Vectors of at most ``FAN`` parts are summed together, round after round."""
    parts = vectors.agg(F.max("part")).first()[0] or 0
    summed = vectors
    while True:
        near = summed.withColumn("part", F.floor(F.col("part") / FAN))
        summed = near.groupBy("block", "part").applyInArrow(_add_vectors, "block long, part long, counts binary")
        parts //= FAN
        if not parts:
            return summed.drop("part")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pairs, counts in zip(batch.column(0), batch.column(1)):
            pair = np.frombuffer(pairs.as_buffer(), "<i8")
            n = np.frombuffer(counts.as_buffer(), "<i8") if counts.is_valid else np.zeros(len(pair), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


@dataclass(frozen=True)
class PairCounts:
    """``table``: of each block its shifts, pairs and counts, stored. ``blocks`` is their number, ``sizes`` those of the vocabularies."""

    table: DataFrame
    blocks: int
    sizes: tuple[int, int]

    def rows(self) -> DataFrame:
        """``a_id, b_id, n``: in how many texts each pair is linked."""
        found = self.table.select("pairs", "counts").mapInArrow(_counted, "pair long, n long")
        return found.where("n > 0").selectExpr(f"pair div {self.sizes[1]} AS a_id", f"pair % {self.sizes[1]} AS b_id", "n")

    def ranges(self, limit: int) -> list[tuple[int, int]]:
        """Ranges of blocks of at most ``limit`` bytes each, but one block at least."""
        step = max(1, limit // (BLOCK * PAIR_BYTES))
        return [(low, min(low + step, self.blocks)) for low in range(0, self.blocks, step)]


def _range(table: DataFrame, blocks: int, low: int, high: int, *more: str) -> tuple[Function, list]:
    rows = table.where(F.col("block").between(low, high - 1)).orderBy("block").select("block", "shifts", "pairs", *more).collect()
    return Function(blocks, low, [(r["block"], bytes(r["shifts"]), bytes(r["pairs"])) for r in rows]), rows


def pair_counts(chunks: DataFrame, sent, sizes: tuple[int, int], limit: int) -> PairCounts:
    """Counts, for every pair that is linked anywhere, the texts of ``chunks`` it is linked in."""
    context = chunks.sparkSession.sparkContext
    pairs = written(chunks.mapInArrow(_pairs(sent), "pair long").distinct(), "pairs")
    blocks = max(1, -(-pairs.count() // BLOCK))
    dealt = pairs.mapInArrow(_in_blocks(blocks), "block long, pair long")
    built = written(dealt.groupBy("block").applyInArrow(_build, "block long, shifts binary, pairs binary"), "function")
    table = None
    for low, high in PairCounts(built, blocks, sizes).ranges(limit):
        numbered = context.broadcast(_range(built, blocks, low, high)[0])
        vectors = written(chunks.mapInArrow(_vectors(sent, numbered), "block long, part long, counts binary"), "vectors")
        numbered.destroy()
        here = built.where(F.col("block").between(low, high - 1)).join(tree_sum(vectors), "block", "left")
        here = written(here, "counts")
        table = here if table is None else table.unionByName(here)
    return PairCounts(table, blocks, sizes)


def _look_up(sent, known, last: bool) -> Callable:
    """Adds counts of the pairs of one range; with the last range each text gets its row, with all numbers and groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, counts, best = known.value
        size_b = sent.value[0][1]
        for batch, row, chunk in _aligned_chunks(sent, batches):
            here, found = function(chunk.pairs)
            n, top = np.zeros(len(chunk.pairs), np.int64), np.zeros(len(chunk.pairs), np.int64)
            n[here] = counts[found]
            top[here] = counts[found] == best[chunk.pairs[here] // size_b]
            before = [batch.column(name)[row].as_buffer() if batch.column(name)[row].is_valid else None for name in TOTALS[4:]]
            sums = [chunk.by_text(chunk.by_unit(x)) * chunk.whole for x in (top, n)]
            sums = [x if old is None else x + np.frombuffer(old, "<i8") for x, old in zip(sums, before)]
            if not last:
                same = [batch.column(k).slice(row, 1) for k in range(1 + len(PARTS))]
                added = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in sums]
                yield pa.RecordBatch.from_arrays([*same, *added], names=["rows", *PARTS, *TOTALS[4:]])
                continue
            cut = np.bincount(chunk.unit_a[chunk.met.cut_a], minlength=chunk.units)
            numbers = [chunk.by_text(x) * chunk.whole for x in (chunk.n_a, chunk.n_b, cut, chunk.many)]
            columns = [pa.array(x, pa.int64()) for x in (*numbers, *sums)]
            rows = batch.column("rows").slice(row, 1).flatten()
            yield pa.RecordBatch.from_arrays([rows, *columns, pa.array(chunk.groups(), pa.string())], names=["row", *TOTALS, "groups"])

    return run


def aligned(docs: DataFrame, first: str, second: str, text: str = "text", keep: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns ``keep``, all by default), the numbers ``TOTALS`` and ``groups``.

    ``first`` names the file of a byte-level tokenizer (JSON), ``second`` that of a piece tokenizer; both are
    read on the driver and sent along, two megabytes. ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``. A text that is null,
    empty, or not given back whole by both has no tokens: zeros and an empty text. Rows are counted as
    documents, repeated ones and those without an id too. An empty table gives an empty one. ``limit`` bounds the bytes of the
    function sent at once.
    """
    spark = docs.sparkSession
    files = Path(first).read_text(encoding="utf-8"), Path(second).read_bytes()
    vocabularies = spark.sparkContext.broadcast(files)
    tools = Tokenizers(*files)
    sent = spark.sparkContext.broadcast((tools.sizes, tools.lengths))
    limit = broadcast_limit(spark) if limit is None else limit

    binary = F.col(f"`{text}`").cast("string").cast("binary").alias("text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in (keep or docs.columns))).alias("row"), binary)
    row = rows.schema["row"].dataType
    parts = [T.StructField("rows", T.ArrayType(row)), *(T.StructField(name, T.BinaryType()) for name in PARTS)]
    path = fresh_path(spark, "chunks")
    rows.mapInArrow(_chunks(vocabularies), T.StructType(parts)).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(T.StructType(parts)).parquet(path)

    counts = pair_counts(chunks.select(*PARTS), sent, tools.sizes, limit)
    most = counts.rows().groupBy("a_id").agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(tools.sizes[0], np.int64)
    best[most.column("a_id").to_numpy()] = most.column("n").to_numpy()

    running = [T.StructField(name, T.BinaryType()) for name in TOTALS[4:]]
    found = chunks.withColumns({name: F.lit(None).cast("binary") for name in TOTALS[4:]})
    totals = [T.StructField(name, T.LongType()) for name in TOTALS]
    ranges = counts.ranges(limit)
    for low, high in ranges:
        function, table = _range(counts.table, counts.blocks, low, high, "counts")
        packed = [np.frombuffer(r["counts"], "<i8") if r["counts"] else np.zeros(len(r["pairs"]) // 8, np.int64) for r in table]
        known = spark.sparkContext.broadcast((function, np.concatenate(packed or [np.zeros(0, np.int64)]), best))
        last = (low, high) == ranges[-1]
        schema = [T.StructField("row", row), *totals, T.StructField("groups", T.StringType())] if last else [*parts, *running]
        found = found.mapInArrow(_look_up(sent, known, last), T.StructType(schema))
        if not last:
            found = written(found, "looked-up")
            known.destroy()
    return found


def token_alignment(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Per row of ``docs``: doc_id, the numbers and a digest of the groups, empty without tokens; edges as in ``aligned``."""
    found = aligned(docs, first, second, keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), *TOTALS, digest.alias("groups_sha256"))
