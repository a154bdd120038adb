"""Phrases of two to four words by dynamic itemset counting.

The tokens are laid out in shards that are scanned in a cycle. All lengths are counted in the
same scan: words from the beginning, a longer phrase from the scan after both its parts (without
its last and without its first word) have reached the threshold, each for one full cycle, so every
phrase that is frequent ends with its exact count. Phrases that complete their cycle below the threshold are
dropped; the scans end when nothing is being counted any more, after four cycles at most.

What has reached the threshold is told to the scans by an array of fixed size that holds, by hash,
the first step at which a phrase of that hash did. Hashes that coincide only start a phrase earlier than need be: its first
step is a function of the array alone, so it is still counted for exactly one cycle, and exactly.
Phrases themselves are rows of 64-bit word numbers, checked against the words at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from climagest.llm.shingles import mix
from climagest.operators.numbering import number_rows
from climagest.sources.shared import fresh_path, small, written

CUT = re.compile(rb"[.,;:!?\n-\r]")
BETWEEN = 0  # stands between pieces; no word has this number
NEVER = 255
CHUNK = 1 << 17  # tokens in a row of a shard, more only within one document
PENDING = 1 << 20  # occurrences put together before they leave a task
WORDS_KNOWN = 400_000  # words remembered in a task; beyond that it starts anew
WORD_BYTES = 8
_TURN = np.uint64(0x9E3779B97F4A7C15)

TOKENS = "lang string, words binary, codes binary, n long, id long, word string, shard int"


@dataclass(frozen=True)
class Mining:
    """``least`` occurrences make a candidate; one with ``inside`` per cent of its occurrences inside a longer candidate goes.

    ``shards`` scans are a cycle. ``cells`` is the size of the array sent to every scan, one byte each, a power of two.
    """

    least: int = 30
    longest: int = 4
    inside: int = 80
    top: int = 2000
    shards: int = 3
    cells: int = 1 << 24


class Numbers(dict):
    """Words of one language and their numbers; ``fresh`` are those met since it was last emptied."""

    def __init__(self, lang: str) -> None:
        named = lang.encode()
        # the length first: a language or a word may hold any byte, zero too
        self.lang, self.prefix, self.fresh = lang, len(named).to_bytes(8, "little") + named, []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = xxhash.xxh3_64_intdigest(self.prefix + word) or 1
        self.fresh.append((number, word))
        return number


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece, A-Z lower-cased. In a piece ``bytes.split`` cuts at space and tab only, as the other white space ends it."""
    for piece in CUT.split(text.lower()):
        words = piece.split()
        if words:
            yield words


def _tokenizer(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        held: dict[str, list[int]] = {}
        turn = TaskContext.get().partitionId()

        def rows(langs: list[str]) -> pa.RecordBatch:
            nonlocal turn
            out: dict[str, list] = {name: [] for name in ("lang", "words", "codes", "n", "id", "word", "shard")}
            for lang in langs:
                numbers, codes = np.unique(np.array(held.pop(lang), np.uint64), return_inverse=True)
                n = len(codes) - int((numbers[codes] == BETWEEN).sum())
                row = (lang, numbers.tobytes(), codes.astype("<u4").tobytes(), n, None, None, turn % shards)
                turn += 1
                for column, value in zip(out.values(), row):
                    column.append(value)
                for number, word in known[lang].fresh:
                    row = (lang, None, None, None, number - (number >> 63 << 64), word.decode("utf-8", "replace"), -1)
                    for column, value in zip(out.values(), row):
                        column.append(value)
                known[lang].fresh = []
                if len(known[lang]) > WORDS_KNOWN:
                    known[lang].clear()
            types = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = known.setdefault(lang, Numbers(lang))
                ids = held.setdefault(lang, [])
                for words in pieces(text.as_py() or b""):
                    ids.extend(map(numbers.__getitem__, words))
                    ids.append(BETWEEN)
                if len(ids) >= CHUNK:
                    yield rows([lang])
                elif sum(map(len, held.values())) >= 4 * CHUNK:
                    yield rows(list(held))
        if held:
            yield rows(list(held))

    return run


def shard_tokens(docs: DataFrame, text: str, lang: str, shards: int) -> DataFrame:
    """The tokens of all texts in rows dealt to ``shards``; rows of shard -1 hold the words and their numbers."""
    spark = docs.sparkSession
    read = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.col(f"`{text}`").cast("string").cast("binary").alias("text"),
    )
    path = fresh_path(spark, "shards")
    read.mapInArrow(_tokenizer(shards), TOKENS).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(TOKENS).parquet(path)


def phrase_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of each row of word numbers; that of a phrase follows from the hash without its last word."""
    words = mix(ids)
    found = words[:, 0]
    for k in range(1, ids.shape[1]):
        found = longer_hash(found, words[:, k])
    return found


def longer_hash(found: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(found * _TURN + word)


def _summed(keys: list[np.ndarray], hashes: list[np.ndarray], begins: list[np.ndarray]) -> pa.RecordBatch:
    """Equal phrases next to each other are one row; a coincidence of hashes only leaves more rows."""
    key, found, begin = np.concatenate(keys), np.concatenate(hashes), np.concatenate(begins)
    order = np.argsort(found)
    key, begin = key[order], begin[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    firsts = np.flatnonzero(new)
    return _rows(key[firsts], np.diff(np.append(firsts, len(key))), begin[firsts])


def _rows(key: np.ndarray, n: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    width = key.shape[1] * WORD_BYTES
    offsets = np.arange(len(key) + 1, dtype=np.int32) * np.int32(width)
    packed = np.ascontiguousarray(key.astype("<u8")).tobytes()
    binary = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed)])
    return pa.RecordBatch.from_arrays([binary, pa.array(n.astype(np.int64)), pa.array(begin.astype(np.int32))], names=["key", "n", "begin"])


def _scanner(step: int, mining: Mining, sent) -> Callable:
    """Counts, in one shard, what is in its cycle at ``step``: phrase, occurrences and the step it began at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(sent.value, np.uint8)
        mask = np.uint64(len(cells) - 1)
        held = {k: ([], [], []) for k in range(2, mining.longest + 1)}
        for batch in batches:
            for words, packed in zip(batch.column(0), batch.column(1)):
                numbers = np.frombuffer(words.as_buffer(), "<u8")
                codes = np.frombuffer(packed.as_buffer(), "<u4")
                ids, mixed = numbers[codes], mix(numbers)
                if step < mining.shards:
                    often = np.bincount(codes, minlength=len(numbers))
                    real = numbers != BETWEEN
                    yield _rows(numbers[real][:, None], often[real], np.zeros(int(real.sum())))
                first_step = cells[mixed & mask].astype(np.int16)
                first_step[numbers == BETWEEN] = NEVER
                single, reached, found = mixed[codes], first_step[codes], mixed[codes]
                for length in range(2, mining.longest + 1):
                    # windows both of whose parts have been reached; none holds a place between pieces
                    both = np.maximum(reached[:-1], reached[1:])
                    at = np.flatnonzero(both != NEVER)
                    begin = both[at] + 1
                    hashes = longer_hash(found[at], single[at + length - 1])
                    now = (begin <= step) & (step < begin + mining.shards)
                    if now.any():
                        keys, kept, begins = held[length]
                        keys.append(ids[at[now][:, None] + np.arange(length)])
                        kept.append(hashes[now])
                        begins.append(begin[now])
                        if sum(map(len, kept)) >= PENDING:
                            yield _summed(*held[length])
                            held[length] = ([], [], [])
                    if not len(at):
                        break
                    reached = np.full(len(both), NEVER, np.int16)
                    found = np.zeros(len(both), np.uint64)
                    reached[at], found[at] = cells[hashes & mask], hashes
        for lists in held.values():
            if lists[0]:
                yield _summed(*lists)

    return run


def _cells(mask: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: dict[int, list[bytes]] = {}
            for key in batch.column(0).to_pylist():
                keys.setdefault(len(key), []).append(key)
            for width, same in keys.items():
                ids = np.frombuffer(b"".join(same), "<u8").reshape(len(same), width // WORD_BYTES)
                places = np.unique(phrase_hash(ids) & np.uint64(mask)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places)], names=["cell"])

    return run


def discard(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing will read again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def frequent_phrases(tokens: DataFrame, mining: Mining) -> DataFrame:
    """``key`` (word numbers) and ``n`` of every phrase of up to ``longest`` words with ``least`` occurrences."""
    spark = tokens.sparkSession
    result, state, before, step, latest = fresh_path(spark, "phrases"), None, None, 0, 0
    cells = np.full(mining.cells, NEVER, np.uint8)
    last = mining.longest * mining.shards  # no phrase can begin later
    while step < last:
        sent = spark.sparkContext.broadcast(cells.tobytes())
        shard = tokens.where(F.col("shard") == step % mining.shards).select("words", "codes")
        rows = shard.mapInArrow(_scanner(step, mining, sent), "key binary, n long, begin int").withColumn("old", F.lit(0))
        if state is not None:
            rows = rows.unionByName(state.select("key", "n", "begin", F.col("n").alias("old")))
        merged = rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("begin").alias("begin"), F.sum("old").alias("old"))
        enough, ended = F.col("n") >= mining.least, F.col("begin") + mining.shards <= step + 1
        path = fresh_path(spark, "counting")
        merged.where(enough | ~ended).write.parquet(path)
        sent.destroy()
        stored = spark.read.schema(merged.schema).parquet(path)
        stored.where(enough & ended).select("key", "n").write.mode("append").parquet(result)
        grown = stored.where(enough & (F.col("old") < mining.least) & (F.length("key") < mining.longest * WORD_BYTES))
        places = grown.select("key").mapInArrow(_cells(mining.cells - 1), "cell long").distinct().toArrow()
        places = places.column("cell").to_numpy()
        if len(places):
            cells[places[cells[places] == NEVER]], latest = step, step
        state = stored.where(~ended)
        if before:
            discard(spark, before)
        before, step = path, step + 1
        if step > latest + mining.shards:  # every shard has been scanned since, and all cycles have ended
            break
    return spark.read.schema("key binary, n long").parquet(result)


def _part(start: str, words: str) -> str:
    return f"substring(key, CAST(({start}) * {WORD_BYTES} + 1 AS INT), CAST(({words}) * {WORD_BYTES} AS INT))"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", mining: Mining = Mining()) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A null text is empty; a null language is ``und``. Repeated rows count again. Ties in score go to the
    phrase with more occurrences, then to the smaller in byte order, so ranks are definite. A text may be
    of any length. An empty table, or one without frequent phrases, gives no rows. Other columns are not read.
    """
    tokens = shard_tokens(docs, text, lang, mining.shards)
    frequent = frequent_phrases(tokens, mining)
    size = F.floor(F.length("key") / WORD_BYTES).cast("int")
    candidates = frequent.select("key", F.col("n").alias("a"), size.alias("size")).where("size > 1")

    cuts = candidates.select("key", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.selectExpr("key", "a", "k", f"{_part('0', 'k')} AS head", f"{_part('k', 'size - k')} AS rest")
    heads, rests = (frequent.select(F.col("key").alias(part), F.col("n").alias(name)) for part, name in (("head", "l"), ("rest", "r")))
    scored = cuts.join(heads, "head").join(rests, "rest").selectExpr(
        "key", "a", "struct(CAST(2000000 AS DECIMAL(19,0)) * a div (CAST(l AS DECIMAL(19,0)) + r) AS score, k, l, r) AS cut"
    )
    best = scored.groupBy("key", "a").agg(F.min("cut").alias("cut"))

    inner = f"transform(sequence(0, size - m), i -> {_part('i', 'm')})"
    parts = candidates.where("size > 2").selectExpr("a", f"explode(flatten(transform(sequence(2, size - 1), m -> {inner}))) AS key")
    longer = parts.groupBy("key").agg(F.max("a").alias("longer"))
    kept = best.join(longer, "key", "left").where(
        f"longer IS NULL OR CAST(100 AS DECIMAL(19,0)) * longer < CAST({mining.inside} AS DECIMAL(19,0)) * a"
    )
    kept = written(kept.select("key", "a", "cut.*"), "kept")

    # the words of frequent numbers; two words under one number would be an error, not a wrong count
    places = f"transform(sequence(0, length(key) div {WORD_BYTES} - 1), i -> {_part('i', '1')})"
    spelled = kept.selectExpr("key", f"posexplode({places}) AS (place, part)")
    frequent_words = frequent.where(F.length("key") == WORD_BYTES).select(F.col("key").alias("part"), _number("key").alias("id"))
    words = tokens.where("shard = -1").select("id", "lang", "word").join(small(written(frequent_words, "numbers")), "id")
    names = words.groupBy("part").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lang", "word")))
    clash = (F.col("min_word") != F.col("max_word")) | (F.col("min_lang") != F.col("max_lang"))
    wrong = F.raise_error(F.concat(F.lit("two words have one number: "), "min_word", F.lit(", "), "max_word"))
    word = F.when(clash, wrong.cast("string")).otherwise(F.col("min_word"))
    names = written(names.select("part", F.col("min_lang").alias("lang"), word.alias("word")), "words")
    ordered = F.array_sort(F.collect_list(F.struct("place", "word")))
    phrases = spelled.join(names, "part").groupBy("key").agg(
        F.min("lang").alias("lang"), F.array_join(ordered.getField("word"), " ").alias("phrase")
    )
    totals = tokens.where("shard >= 0").groupBy("lang").agg(F.sum("n").alias("n"))
    rows = kept.join(phrases, "key").join(F.broadcast(written(totals, "totals")), "lang")
    rows = rows.withColumns({"down": -F.col("score"), "fewer": -F.col("a")})
    ranked = number_rows(rows.drop("key", "k"), ["down", "fewer", "phrase"], within=["lang"], name="rank")
    return ranked.where(F.col("rank") <= mining.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _number(key: str) -> Column:
    """The signed 64-bit number whose eight bytes, the lowest first, are a key."""
    digits = F.concat(*(F.substring(F.hex(key), 15 - 2 * k, 2) for k in range(WORD_BYTES)))
    return F.conv(digits, 16, -10).cast("long")
