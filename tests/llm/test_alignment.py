"""Alignment of two tokenizers against whole texts encoded by the libraries and linked in plain Python."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from climagest.llm.alignment import FAN, TOTALS, Function, aligned, block_of, displaced, token_alignment, tree_sum

FIRST, SECOND = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
FOLDER = "/root/testdata/sf0.001"


def byte_of() -> dict[str, int]:
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Brute:
    def __init__(self) -> None:
        self.a = Tokenizer.from_file(FIRST)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
        self.letters = byte_of()

    def tokens(self, text: str | None):
        if not text:
            return [], []
        whole = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.letters.get(c, 0) for c in self.a.id_to_token(i))) for i in a]
        b = []
        for i in self.b.encode(text):
            name = self.b.id_to_piece(i)
            b.append((i, bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()))
        same = b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
        return (a, b) if same else ([], [])

    def links(self, a, b):
        spans = []
        for side in (a, b):
            at, found = 0, []
            for number, token in side:
                found.append((number, at, at + len(token)))
                at += len(token)
            spans.append(found)
        pairs, j = [], 0
        for number, start, stop in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < stop:
                pairs.append((number, spans[1][k][0]))
                k += 1
        both = {stop for _, _, stop in spans[0]} & {stop for _, _, stop in spans[1]}
        groups = []
        for stop in sorted(both):
            start = max((s for s in both if s < stop), default=0)
            groups.append("|".join(",".join(str(n) for n, s, e in side if start <= s and e <= stop) for side in spans))
        return pairs, groups


def expected(rows):
    brute = Brute()
    found = [(i, *brute.tokens(text)) for i, text in rows]
    linked = [brute.links(a, b) for _, a, b in found]
    count = collections.Counter(pair for pairs, _ in linked for pair in set(pairs))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, a, b), (pairs, groups) in zip(found, linked):
        text = ";".join(groups)
        out.append(
            (
                i,
                len(a),
                len(b),
                len(groups),
                len(pairs),
                sum(count[p] == best[p[0]] for p in pairs),
                sum(count[p] for p in pairs),
                hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return sorted(out, key=repr)


def rows_of(table):
    return sorted(map(tuple, table.select("doc_id", *TOTALS, "groups_sha256").collect()), key=repr)


ODD = [
    (1, "a  b and   c"),
    (2, " leading"),
    (3, "trailing "),
    (4, "line one\nline two\r\n\tthree"),
    (5, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (6, "it's 3.14, ½ ² x² — “quotes” … ▁ here"),
    (7, "it is ▁"),
    (8, "漢字 かな 한국어 ไทย emoji 😀 👩‍👩‍👧 é ́ x"),
    (9, "nbsp here 　 wide"),
    (10, "plain words and plain words again"),
    (10, "plain words and plain words again"),
    (None, "plain words"),
    (11, None),
    (12, ""),
    (13, " "),
    (14, "x" * 3000 + " " + "word " * 2000 + "end"),
    (15, "a _b (c) 'd \"e -f"),
    (16, "ﬁne ﬁ Å Ⅳ"),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    assert rows_of(token_alignment(docs, FIRST, SECOND)) == expected(ODD)


def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(token_alignment(docs.repartition(40), FIRST, SECOND)) == expected(rows)


def test_ranges_of_the_function(spark, monkeypatch):
    """A function sent in several ranges gives the same."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    whole = aligned(docs, FIRST, SECOND, keep=["doc_id"]).drop("row").collect()
    monkeypatch.setattr("climagest.llm.alignment.BLOCK", 2000)
    parts = aligned(docs, FIRST, SECOND, keep=["doc_id"], limit=1).drop("row").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_edges(edges, nothing):
    found = aligned(edges, FIRST, SECOND)
    assert found.select("row.*").columns == edges.columns
    assert found.count() == edges.count()
    assert token_alignment(nothing, FIRST, SECOND).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 100, 5000])
def test_function_is_minimal_and_perfect(size):
    keys = np.unique(np.random.default_rng(size).integers(0, 2**31, size))
    blocks = block_of(keys, 3)
    rows = []
    for block in np.unique(blocks).tolist():
        shifts, placed = displaced(keys[blocks == block])
        rows.append((block, shifts.astype("<i4").tobytes(), placed.astype("<i8").tobytes()))
    function = Function(3, 0, rows)
    here, found = function(keys)
    assert len(here) == len(keys) and sorted(found.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        function(np.array([2**33]))


def test_tree_sum(spark):
    parts = FAN * FAN + 3
    rows = [(b, p, np.array([p, b, 1], "<i8").tobytes()) for b in range(2) for p in range(parts)]
    total = tree_sum(spark.createDataFrame(rows, "block long, part long, counts binary")).collect()
    found = {r["block"]: np.frombuffer(r["counts"], "<i8").tolist() for r in total}
    assert found == {b: [parts * (parts - 1) // 2, b * parts, parts] for b in range(2)}
