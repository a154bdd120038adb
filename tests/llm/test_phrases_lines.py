"""Phrases and line rules against plain Python, and on odd tables."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from climagest.llm import phrases
from climagest.llm.line_rules import Rules, counted, keep_clean, line_report
from climagest.llm.phrases import Mining, collocations


def mined(rows, mining):
    """Rank by rank, from (text, lang) rows."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, mining.longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= mining.least}
        best = []
        for p, a in candidates.items():
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = [
                b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if not any(100 * b >= mining.inside * a for b in inside):
                best.append((-score, -a, " ".join(p).encode(), l, r))
        best.sort()
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(best[: mining.top], 1)]
    return sorted(out)


def texts(seed, number):
    rng = random.Random(seed)
    words = ["The", "of", "a", "é", "漢字", "x1", "new", "york", "city", "Hall", "-"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(number):
        parts = [rng.choice(words[: rng.choice((4, 11, 51))]) + rng.choice((" ", " ", " ", "\t", ", ", ".\n", "  ")) for _ in range(60)]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(60), "new york city hall ")
        rows.append(("".join(parts), rng.choice(("en", "en", "de", None))))
    return rows


@pytest.mark.parametrize("mining", [Mining(), Mining(least=5, shards=1, cells=16), Mining(least=4, shards=4, cells=1 << 12, top=25)])
def test_phrases(spark, mining, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rows = texts(11, 250)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    assert sorted(map(tuple, collocations(docs, mining=mining).collect())) == mined(rows, mining)


def test_phrases_edges(edges, nothing):
    rows = [(r.text, r.lang) for r in edges.collect()]
    mining = Mining(least=3)
    assert sorted(map(tuple, collocations(edges, mining=mining).collect())) == mined(rows, mining)
    assert collocations(nothing).count() == 0


def test_phrases_zero_bytes(spark):
    """A zero byte that ends a language is not one that begins a word."""
    rows = [("\0w v \0w u", "a"), ("w v w t", "a\0"), ("\0 v", ""), (None, "empty")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = sorted(map(tuple, collocations(docs).collect()))
    assert found == mined(rows, Mining()) and {row[0] for row in found} == {"a", "a\0", ""}


def test_counts_of_a_text():
    text = "One two three four\nOne two three\n\n \nOne two three\n#a $b é漢\u00a0x"  # no ASCII white space, so one word
    assert counted(text.encode())[0] == [13, len(re.sub("[ \t-\r]", "", text)), 2, 1, 9]
    assert counted(b"")[0] == [0, 0, 0, 0, 0]
    assert counted(b" \n\t\n")[0] == [0, 0, 0, 0, 0]
    assert counted(b"a a a a")[0][4] == 4


def test_host_lines(spark):
    """A line of most documents of one host goes there and nowhere else; a text is no boilerplate by its copies."""
    letters = "abcdefghij"
    name = lambda n: letters[n // 10] + letters[n % 10]
    body = [" ".join(name(i) + name(k) for k in range(60)) for i in range(40)]
    rows = [(i, f"Cookie  notice {i:02d}\n{body[i]}", "a") for i in range(40)]
    rows += [(100 + i, body[i], "b") for i in range(40)] + [(200, "COOKIE notice 07\n" + body[0], "b")]
    rows += [(300 + i, body[0] + " copied", "c") for i in range(50)]
    rows += [(400, "Cookie notice 01\n" * 30 + "some more words", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in line_report(docs).collect()}
    assert all(found[i].lost_words == 3 and found[i].kept for i in range(40))
    assert found[200].lost_words == 0 and all(found[300 + i].kept for i in range(50))
    assert found[400].lost_words == 90 and not found[400].kept
    left = {r.doc_id: r.text for r in keep_clean(docs).collect()}
    assert left[3] == body[3] and left[200].startswith("COOKIE") and 400 not in left
    lenient = line_report(docs, Rules(documents=1000))
    assert lenient.where("lost_words > 0").count() == 0


def test_line_edges(edges, nothing):
    found = line_report(edges)
    assert found.count() == edges.count()
    assert not found.where(F.col("doc_id").isin(4, 5, 6)).where("kept").count()
    kept = keep_clean(edges.withColumnRenamed("note", "a.b"))
    assert "a.b" in kept.columns and kept.count() == found.where("kept").count()
    assert line_report(nothing).count() == keep_clean(nothing).count() == 0
