"""Quality rules on lines: what a text repeats in itself, and what a host repeats across its documents.

Every line with a word is normalised (A-Z lower-cased, digits to 0, white space to single spaces)
and hashed. A line that stands in more than a share of a host's distinct documents belongs to the
host and not to the document, and is removed; a document that loses most of its words that way is
rejected. Copies of one text count as one document, so a text is no boilerplate by being copied.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climagest.llm.shingles import digest
from climagest.sources.shared import small, written

WINDOW = 3
LEAST_WORDS = 50
REPEATED = 50  # largest share of words in repeated windows, in hundredths
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
FOLD = bytes.maketrans((string.ascii_uppercase + string.digits).encode(), (string.ascii_lowercase + "0" * 10).encode())

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = T.ArrayType(T.StructType([T.StructField("line", T.BinaryType()), T.StructField("words", T.LongType())]))
ARROW_LINES = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())]))


@dataclass(frozen=True)
class Rules:
    """A line goes if at least ``documents`` and over ``share`` per cent of its host's documents have it;
    a document goes if over ``lost`` per cent of its words do."""

    documents: int = 20
    share: int = 10
    lost: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more; windows are compared whole, not by hash."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(word, len(known)) for word in words], np.int64)
    windows = codes[:n]
    for k in range(1, WINDOW):
        _, windows = np.unique(windows * len(known) + codes[k : k + n], return_inverse=True)
    twice = np.bincount(windows)[windows] > 1
    inside = np.zeros(len(words), bool)
    for k in range(WINDOW):
        inside[k : k + n] |= twice
    return int(inside.sum())


def normal_line(line: bytes) -> list[bytes]:
    return line.translate(FOLD).split()


def counted(data: bytes) -> tuple[list[int], list[dict]]:
    """The counts of one text, and its distinct normalised lines with the words they hold in it."""
    words = data.split()
    points = len(data.translate(None, INNER + SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, again, lines = set(), 0, {}
    for line in data.split(b"\n"):
        parts = normal_line(line)
        if parts:
            again += line in seen
            seen.add(line)
            key = digest(b" ".join(parts))
            lines[key] = lines.get(key, 0) + len(parts)
    return [len(words), points, symbols, again, repeated_words(words)], [{"line": k, "words": n} for k, n in lines.items()]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, texts, host = batch.columns
        counts, lines, contents = [], [], []
        for value in texts:
            data = value.as_py() or b""
            numbers, found = counted(data)
            counts.append(numbers)
            lines.append(found)
            contents.append(digest(data))
        table = np.array(counts, np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays(
            [row, host, pa.array(contents, pa.binary()), *(pa.array(c) for c in table.T.copy()), pa.array(lines, ARROW_LINES)],
            names=["row", "host", "content", *COUNTS, "lines"],
        )


def measured(docs: DataFrame, keep: list[str], text: str, host: str) -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` as ``row``, its host, a digest of its text, its counts and lines."""
    binary, quoted = T.BinaryType(), [F.col(f"`{name}`") for name in keep]
    rows = docs.select(
        F.struct(*quoted).alias("row"),
        F.col(f"`{text}`").cast("string").cast("binary").alias("text"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"),
    )
    added = [("host", T.StringType()), ("content", binary), *((name, T.LongType()) for name in COUNTS), ("lines", LINES)]
    schema = T.StructType([rows.schema["row"], *(T.StructField(name, kind) for name, kind in added)])
    return written(rows.mapInArrow(_measure, schema), "measured")


def frequent_lines(lines: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """The lines of each host that too many of its distinct documents have; a few per host."""
    sizes = pages.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    often = counts.where(F.col("documents") >= rules.documents).join(small(written(sizes, "hosts")), "host")
    return often.where(F.col("documents") * 100 > F.col("of") * rules.share).select("host", "line")


def judged(
    docs: DataFrame, keep: list[str], text: str = "text", host: str = "source", rules: Rules = Rules()
) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns ``keep``), the counts, ``lost_words``, ``gone`` (digests of
    the lines to remove), ``base_failed`` and ``kept``.

    A null text is empty and has no words, so it fails. A null host is the host without a name. Rows with
    the same text and host are one document when lines are counted, whatever their ids, and are
    judged alike, each in its own row. An empty table gives an empty one. Names of ``docs`` may clash with any used here.
    """
    pages = measured(docs, keep, text, host)
    # equal texts of a host are merged here, before anything is counted
    lines = pages.select("host", "content", F.inline("lines")).groupBy("host", "content", "line").agg(F.max("words").alias("words"))
    lines = written(lines, "lines")
    often = written(frequent_lines(lines, pages, rules), "often")
    lost = lines.join(small(often), ["host", "line"]).groupBy("host", "content")
    lost = lost.agg(F.sum("words").alias("lost_words"), F.collect_list("line").alias("gone"))
    found = pages.drop("lines").join(lost, ["host", "content"], "left")
    n, lost_words = F.col("n_words"), F.coalesce("lost_words", F.lit(0))
    failed: Column = (n < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > n * REPEATED)
    return found.select(
        "row",
        *COUNTS,
        lost_words.alias("lost_words"),
        F.coalesce("gone", F.array().cast("array<binary>")).alias("gone"),
        failed.alias("base_failed"),
        (~failed & (lost_words * 100 <= n * rules.lost)).alias("kept"),
    )


def line_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row of ``docs``: doc_id, its counts and whether it stays; nulls, copies and empty tables as in ``judged``."""
    found = judged(docs, ["doc_id"], rules=rules)
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), *COUNTS, "lost_words", "base_failed", "kept")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, texts, gone = batch.columns
        left = []
        for text, lines in zip(texts.to_pylist(), gone.to_pylist()):
            drop = set(lines)
            if drop:
                kept = (x for x in text.split(b"\n") if not (parts := normal_line(x)) or digest(b" ".join(parts)) not in drop)
                text = b"\n".join(kept)
            left.append(text.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([row, pa.array(left, pa.string())], names=["row", "left"])


def keep_clean(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, without the lines that belong to their host."""
    found = judged(docs, docs.columns, text, host, rules).where("kept")
    read = found.select("row", F.col(f"row.`{text}`").cast("string").cast("binary").alias("text"), "gone")
    schema = T.StructType([read.schema["row"], T.StructField("left", T.StringType())])
    left = read.mapInArrow(_without, schema)
    return left.select(*(F.col("left" if c == text else f"row.`{c}`").alias(c) for c in docs.columns))
