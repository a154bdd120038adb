"""Quality by an interpolated modified Kneser-Ney model of character n-grams.

The model is counted over every trusted text. All of its tables (counts, continuation counts,
contexts, probabilities) are DataFrames joined by n-gram, so they are spread by hash and grow with
the corpus. They give a probability to each distinct n-gram of the whole corpus, seen in trusted text or not; those
probabilities are cut into shards of bounded size by hash, and each document adds up, shard by shard, the
logarithms of its n-grams. The text's perplexity is kept or not by quantiles of the trusted texts of its language.

Tokens are characters: words would need as many joined rows as the corpus has words, twice over, while the
distinct character n-grams of a task grow far more slowly than its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climagest.llm.exact_dedup import FILE, ROW, located
from climagest.llm.toxicity import held_out
from climagest.sources.shared import small, written

ORDER = 5
#: Bits of a code. A code point below PLAIN is its own code; any other is two codes, each out of SIDE of its own.
BITS, PLAIN, SIDE = 12, 1920, 1088
START, END = 1, 2
#: Characters counted at once in a worker, and n-grams of a shard sent to all workers.
STRETCH, SHARD = 2_000_000, 4_000_000
#: Kept between these quantiles of the trusted texts' perplexity, in hundredths.
QUANTILES = (1, 99)


def codes(text: str) -> np.ndarray:
    """Character codes between four starts and an end."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    points[points < 3] = 3
    wide = points >= PLAIN
    if wide.any():
        rest = points[wide] - PLAIN
        points[wide] = PLAIN + rest // SIDE
        points = np.insert(points, np.flatnonzero(wide) + 1, PLAIN + SIDE + rest % SIDE)
    return np.concatenate((np.full(ORDER - 1, START), points, [END]))


def n_signs(points: np.ndarray) -> int:
    """Characters of a text and its end, from its codes."""
    return len(points) - ORDER + 1 - int(np.count_nonzero(points >= PLAIN + SIDE))


def n_grams(points: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each character and at the end."""
    n = len(points) - ORDER + 1
    found = np.zeros(n, np.int64)
    for i in range(ORDER):
        found = (found << BITS) | points[i : i + n]
    return found


def _text(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts: list[np.ndarray], trusted: list[bool]) -> pa.RecordBatch:
        marks = np.repeat(np.array(trusted, np.int64), [len(p) for p in parts])
        grams, where = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(where, marks, len(grams)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])

    parts, trusted, size = [], [], 0
    for batch in batches:
        for value, mark in zip(batch.column(0), batch.column(1)):
            parts.append(n_grams(codes(_text(value))))
            trusted.append(mark.as_py())
            size += len(parts[-1])
            if size >= STRETCH:
                yield out(parts, trusted)
                parts, trusted, size = [], [], 0
    if parts:
        yield out(parts, trusted)


def gram_counts(rows: DataFrame) -> DataFrame:
    """``gram, n``: every distinct n-gram of ``text`` (binary) and how often it stands in rows that are ``trusted``."""
    counted = rows.select("text", "trusted").mapInArrow(_counted, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def suffix(gram: Column, length: int) -> Column:
    return gram.bitwiseAND((1 << BITS * length) - 1)


def discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and more, from the numbers of n-grams that occur once to four times."""
    kinds = counts.agg(*(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5))).first()
    ones, twos, threes, fours = (float(x) for x in kinds)
    if not (ones and twos and threes):
        return [0.5, 0.5, 0.5]  # too little text to estimate
    share = ones / (ones + 2 * twos)
    found = [1 - 2 * share * twos / ones, 2 - 3 * share * threes / twos, 3 - 4 * share * fours / threes]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def kneser_ney(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per length from 1: ``gram, p`` of seen n-grams, and ``context, rest``, the mass a context leaves to shorter ones.

    Below the longest, counts are numbers of distinct characters before.
    """
    levels = [written(counts.where("n > 0"), "counts")]
    for length in range(ORDER - 1, 0, -1):
        fewer = levels[0].groupBy(suffix(F.col("gram"), length).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, written(fewer, "counts"))
    probabilities, rests = [], []
    for length, level in enumerate(levels, 1):
        cut = discounts(level)
        off = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        level = level.withColumns({"context": F.shiftright("gram", BITS), "off": off})
        contexts = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        contexts = written(contexts.select("context", "total", (F.col("left") / F.col("total")).alias("rest")), "contexts")
        found = level.join(contexts, "context").withColumn("shorter", suffix(F.col("gram"), length - 1))
        if length == 1:
            found = found.withColumn("below", F.lit(1 / (1 << BITS)))
        else:
            found = found.join(probabilities[-1].toDF("shorter", "below"), "shorter")
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("rest") * F.col("below")
        probabilities.append(written(found.select("gram", p.alias("p")), "probabilities"))
        rests.append(contexts.select("context", "rest"))
    return probabilities, rests


def log_probabilities(counts: DataFrame) -> DataFrame:
    """``gram, log_p`` for every n-gram of ``counts``, those that trusted text lacks by their longest known part."""
    probabilities, rests = kneser_ney(counts)
    grams = counts.select("gram")
    open_, p = F.lit(1.0), F.lit(0.0)
    for length in range(ORDER, 0, -1):
        known = probabilities[length - 1].toDF("part", f"p{length}")
        left = rests[length - 1].toDF("part", f"rest{length}")
        part = suffix(F.col("gram"), length)
        grams = grams.withColumn("part", part).join(known, "part", "left").drop("part")
        grams = grams.withColumn("part", F.shiftright(part, BITS)).join(left, "part", "left").drop("part")
        # once a part is known it stands for all shorter ones
        p = p + open_ * F.coalesce(f"p{length}", F.lit(0.0))
        open_ = open_ * F.when(F.col(f"p{length}").isNull(), F.coalesce(f"rest{length}", F.lit(1.0))).otherwise(0.0)
    return grams.select("gram", F.log(p + open_ / (1 << BITS)).alias("log_p"))


def perplexities(rows: DataFrame, logs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``perplexity`` of each row's ``text`` (binary); ``keys`` must tell rows apart."""
    spark = rows.sparkSession
    shards = max(1, -(-logs.count() // SHARD))
    schema = rows.select(*keys).schema.add("log_p", "double").add("n_signs", "long")
    parts = []
    for shard in range(shards):
        table = logs.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == shard).orderBy("gram").toArrow()
        arrays = [table.column(i).to_numpy() for i in range(2)]
        sent = spark.sparkContext.broadcast(tuple(arrays))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            grams, values = sent.value
            for batch in batches:
                sums, signs = [], []
                for value in batch.column(len(keys)):
                    points = codes(_text(value))
                    own = n_grams(points)
                    at = np.searchsorted(grams, own)
                    at[at == len(grams)] = 0
                    here = grams[at] == own if len(grams) else np.zeros(len(own), bool)
                    sums.append(float(values[at[here]].sum()))
                    signs.append(n_signs(points))
                columns = [*batch.columns[: len(keys)], pa.array(sums, pa.float64()), pa.array(signs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "log_p", "n_signs"])

        parts.append(written(rows.select(*keys, "text").mapInArrow(run, schema), "scored"))
    whole = reduce(DataFrame.union, parts)
    if shards > 1:
        whole = whole.groupBy(*keys).agg(F.sum("log_p").alias("log_p"), F.max("n_signs").alias("n_signs"))
    return whole.withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n_signs"))).drop("log_p", "n_signs")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, perplexity, low, high, kept`` for every row of ``docs``.

    Trusted are documents labelled of quality 1 and not held out. A language without trusted texts goes by the
    quantiles of all. Null texts count as empty: one sign, the end. Without any trusted text all have
    the same perplexity and are kept.
    """
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    rows = located(docs.select("doc_id", "lang", "text"))
    rows = rows.join(small(written(good.withColumn("trusted", F.lit(True)), "trusted")), "doc_id", "left")
    rows = rows.select(
        "doc_id", "lang", FILE, ROW, F.coalesce("trusted", F.lit(False)).alias("trusted"), F.col("text").cast("string").cast("binary").alias("text")
    )
    logs = written(log_probabilities(written(gram_counts(rows), "grams")), "logs")
    scored = perplexities(rows, logs, ["doc_id", "lang", "trusted", FILE, ROW])
    trusted, name = scored.where("trusted"), F.coalesce("lang", F.lit(""))
    bounds = [F.percentile_approx("perplexity", q / 100, 10_000).alias(side) for q, side in zip(QUANTILES, ("low", "high"))]
    by_language = trusted.groupBy(name.alias("language")).agg(*bounds)
    every = trusted.agg(*(bound.alias(f"all_{side}") for bound, side in zip(bounds, ("low", "high"))))
    found = scored.withColumns({"language": name, "one": F.lit(1)}).join(small(written(by_language, "bounds")), "language", "left")
    found = found.join(F.broadcast(every.withColumn("one", F.lit(1))), "one")
    low, high = F.coalesce("low", "all_low"), F.coalesce("high", "all_high")
    kept = F.coalesce(F.col("perplexity").between(low, high), F.lit(True))
    return found.select("doc_id", "lang", "perplexity", low.alias("low"), high.alias("high"), kept.alias("kept"))
