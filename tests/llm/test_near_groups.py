"""Groups of near copies around one text: components as by comparing all pairs, without making all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from climagest.llm import near_dedup
from climagest.llm.near_dedup import near_duplicates
from climagest.llm.shingles import normal, shingle_set


def variants(members: int, changed: tuple[int, ...], seed: int) -> list[str]:
    """Copies of one text of sixty words, in each of which some words are others."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(members):
        words = list(base)
        for at in draw.sample(range(60), draw.choice(changed)):
            words[at] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def by_all_pairs(texts: list[str]) -> list[int]:
    sets = [shingle_set(normal(text.encode())) for text in texts]
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            common = len(one & sets[j])
            if 100 * common >= 75 * (len(one) + len(sets[j]) - common):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("changed", [(1, 2), (2,)])
def test_components_of_a_group(spark, changed, monkeypatch):
    texts = variants(250, changed, 5)
    rows, compare = [], near_dedup.compare
    monkeypatch.setattr(near_dedup, "compare", lambda pairs, t: rows.append(pairs.count()) or compare(pairs, t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == by_all_pairs(texts)
    # in a round, one pair for each member and bin
    assert all(n <= len(texts) << i for i, n in enumerate(rows[1:]))


def test_near_misses_are_compared_without_rows_of_pairs(spark, monkeypatch):
    texts = variants(500, (2,), 7)
    rows, met = [], []
    compare, meetings = near_dedup.compare, near_dedup.meetings
    monkeypatch.setattr(near_dedup, "compare", lambda pairs, t: rows.append(pairs.count()) or compare(pairs, t))
    monkeypatch.setattr(near_dedup, "meetings", lambda tested, *more: met.append(tested.count()) or meetings(tested, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == by_all_pairs(texts)
    # pairs with hubs, and none besides
    assert rows == met


@pytest.mark.parametrize("tile", [7, 40])
def test_components_do_not_depend_on_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "COUNTED", 50)
    texts = variants(200, (1, 2, 3), 11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == by_all_pairs(texts)


def test_common_counts_are_sizes_of_intersections(monkeypatch):
    monkeypatch.setattr(near_dedup, "COUNTED", 3)
    draw = random.Random(3)
    left, right = ([{draw.randrange(40) for _ in range(n)} for n in sizes] for sizes in ((0, 5, 30), (12, 1, 0, 25)))
    arrays = [[np.array(sorted(s), np.uint64) for s in side] for side in (left, right)]
    assert near_dedup.common_counts(*arrays).tolist() == [[len(a & b) for b in right] for a in left]
