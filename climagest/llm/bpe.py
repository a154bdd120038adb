"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string ends, for each of its prefixes, in exactly one token:
the only one whose pair with the last token of what stands before it is a pair that BPE
itself would leave alone. Storing that token for every prefix gives the encoding by
walking back, makes appending exact, and after an edit only the prefixes near it have to
be worked out again, until a stretch as long as the longest token agrees with the old table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climagest.llm.columns import quoted, with_mapped

#: Bytes of pieces (unless told otherwise), and number of pairs, remembered in a worker by each of two generations. Results do not depend on it.
HELD = 56 << 20
PAIRS = 120_000
#: What an entry of a dict, its key's and its value's headers take.
ENTRY = 180
#: A pair of tokens is one number: the left one, plus one, times SHIFT, plus the right one.
SHIFT = 1 << 24
#: Bytes that tell how long the tokens are which may end there.
TAIL = 4


class Vocabulary:
    """Tokens by rank, and which pairs of them stay apart."""

    def __init__(self, lines: bytes) -> None:
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        self.reach: dict[bytes, int] = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            if len(token) >= TAIL:
                tail = token[-TAIL:]
                self.reach[tail] = max(self.reach.get(tail, 0), len(token))
        self.longest = max(map(len, self.ranks))
        self.known: dict[int, bool] = {}
        self.known_before: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None | bool] = {}

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """BPE by repeated merging of the lowest rank, down to ``least`` parts; used on single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def halves(self, token: int) -> tuple[int, int] | None | bool:
        """The two tokens whose merge makes it; None for a single byte, False if BPE never makes it."""
        found = self._halves.get(token, True)
        if found is True:
            parts = self.merged(self.tokens[token], 2)
            found = None if len(self.tokens[token]) == 1 else False
            if found is False and len(parts) == 2 and self.ranks.get(b"".join(self.tokens[t] for t in parts)) == token:
                found = (parts[0], parts[1])
            self._halves[token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side; ``left`` -1 is the text's start."""
        pair = (left + 1) * SHIFT + right
        stays = self.known.get(pair)
        if stays is None:
            stays = self.known_before.get(pair)
            if stays is None:
                stays = self.halves(right) is not False and (left < 0 or self._stay(left, right))
            if len(self.known) >= PAIRS:
                self.known_before = dict(self.known)
                self.known.clear()
            self.known[pair] = stays
        return stays

    def _stay(self, a: int, b: int) -> bool:
        """Goes back in time along the boundary: a merge across it, earlier than the one that used a side, forbids the pair.

        Of equal ranks the one further left comes first.
        """
        limit = 1 << 40
        while True:
            if self.ranks.get(self.tokens[a] + self.tokens[b], limit) < limit:
                return False
            split_a, split_b = self.halves(a), self.halves(b)
            if split_a and (not split_b or a > b):
                limit, a = a, split_a[1]
            elif split_b:
                limit, b = b + 1, split_b[0]
            else:
                return True


class Prefixes:
    """The last token of every prefix of a byte string that can grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Adds to ``last`` the last tokens of the prefixes of ``data`` up to length ``stop``."""
        ranks, reach, apart = self.vocabulary.ranks.get, self.vocabulary.reach.get, self.vocabulary.apart
        known = self.vocabulary.known.get
        for end in range(len(last), stop + 1):
            far = reach(data[end - TAIL : end], TAIL - 1) if end >= TAIL else end
            for start in range(end - far if far < end else 0, end):
                token = ranks(data[start:end])
                if token is not None:
                    stays = known((last[start] + 1) * SHIFT + token)
                    if stays or stays is None and apart(last[start], token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; the number of prefixes worked out again."""
        old, rest = self.last, len(self.data) - stop
        data = self.data[:start] + new + self.data[stop:]
        last, shift, same = old[: start + 1], len(new) - (stop - start), 0
        for end in range(start + 1, len(data) + 1):
            self._extend(data, last, end)
            if end > len(data) - rest:
                same = same + 1 if last[end] == old[end - shift] else 0
                if same >= self.vocabulary.longest:
                    break
        done = len(last)
        self.data, self.last = data, last + old[done - shift :]
        return done - 1 - start

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one match of the split pattern; a piece that is itself a token is that token."""
    whole = vocabulary.ranks.get(piece)
    return [whole] if whole is not None else Prefixes(vocabulary, piece).ids()


class Encoder(dict):
    """Pieces seen so far with their ids, packed, in two generations bounded in bytes.

    When the younger one is full it becomes the older one, from which pieces come back as they are met.
    """

    def __init__(self, lines: bytes, pattern: str, most: int = HELD) -> None:
        self.vocabulary, self.pieces = Vocabulary(lines), regex.compile(pattern).findall
        self.before: dict[str, bytes] = {}
        self.held, self.most = 0, most

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.get(piece)
        if packed is None:
            ids = encode_piece(self.vocabulary, piece.encode())
            packed = struct.pack(f"<{len(ids)}i", *ids)
        self.held += ENTRY + 4 * len(piece) + len(packed)
        if self.held > self.most:
            self.before, self.held = dict(self), 0
            self.clear()
        self[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def encoder(lines: bytes, pattern: str, most: int = HELD) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(lines, pattern, most)


def _text(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    text: str = "text",
    into: str = "tokens",
    keep: list[str] | None = None,
    most: int = HELD,
) -> DataFrame:
    """``docs`` with the array of token ids of ``text``, each match of ``pattern`` encoded separately.

    ``vocabulary`` names a file of base64 tokens with ranks, read on the driver and sent
    along (under a megabyte). A null text counts as empty and has no tokens. Bytes that are not UTF-8 count
    as U+FFFD. Other columns (or those in ``keep``) and repeated rows stay; a column named like ``into`` is replaced.
    ``most`` bounds the bytes of pieces that a generation remembers in a worker.
    """
    lines = Path(vocabulary).read_bytes()

    def start() -> Callable[[pa.Array], pa.Array]:
        codes = encoder(lines, pattern, most)

        def tokens(texts: pa.Array) -> pa.Array:
            ids = [codes.encode(_text(value)) for value in texts]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))

        return tokens

    return with_mapped(docs, text, into, T.ArrayType(T.IntegerType()), start, keep)


def decode(tokens: DataFrame, vocabulary: str, tokens_column: str = "tokens", into: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that its ids stand for; a null array gives null."""
    lines = Path(vocabulary).read_bytes()

    def start() -> Callable[[pa.Array], pa.Array]:
        codes = encoder(lines, "")
        return lambda lists: pa.array([codes.decode(x.values.to_numpy()) if x.is_valid else None for x in lists], pa.binary())

    return with_mapped(tokens, F.col(quoted(tokens_column)), into, T.BinaryType(), start)


def token_digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Number and digest of the ids of every text, and digest of what they decode to.

    One row per row of ``docs``; a null text counts as empty, with no tokens. Texts are encoded
    and decoded in one pass, so neither ids nor bytes leave the task.
    """
    lines = Path(vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(lines, pattern)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for value in batch.column(1):
                ids = codes.encode(_text(value))
                sizes.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codes.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
