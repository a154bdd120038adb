"""License scans: MinHash bands over overlapping windows, exact shingle containment after.

A template is looked for by windows of its own number of words, an eighth of which apart (every
word for short ones), so a verbatim copy meets a window at least 15/17 similar to it. Templates and windows have
16 bands of two coordinates: at 15/17, one copy in 10 billion shares none; at a similarity of one half, one in
a hundred. What shares a band is verified: the share of the template's five-word
shingles found around the window has to reach 0.75.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climagest.llm.columns import with_mapped
from climagest.llm.shingles import WIDTH, Hasher, mix, normal, shingle_set

BANDS, ROWS = 16, 2
CONTAINED = 0.75
#: Texts longer than this many words are scanned in stretches that overlap by the longest template and its margins.
STRETCH = 1 << 16
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

#: Notices and opening paragraphs of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with"
        " the License. You may obtain a copy of the License at"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation"
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
}


def plain(text: bytes | None) -> bytes:
    """Lower-cased words without ASCII punctuation, joined by single spaces."""
    return normal((text or b"").translate(None, PUNCTUATION))


def coordinates(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` numbers per shingle; their minima over a window are its signature."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) + np.arange(1, size + 1, dtype=np.uint32)[:, None]
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(15)
    return x


def window_minima(values: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """Minima of ``width`` neighbours from each start, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:, :-span], values[:, span:])
        span *= 2
    return np.minimum(values[:, starts], values[:, starts + width - span])


def keys(minima: np.ndarray, width: int, bands: int) -> np.ndarray:
    """One key per band and window; it also tells window widths apart."""
    rows = minima.shape[0] // bands
    found = np.broadcast_to((np.arange(bands, dtype=np.uint64) + np.uint64(width << 8))[:, None], (bands, minima.shape[1]))
    for i in range(rows):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + minima[i::rows])
    return found


class Scanner:
    """Templates indexed by the bands of their windows."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.hasher, self.classes = Hasher(), {}
        self.sets = {name: shingle_set(plain(text.encode())) for name, text in templates.items()}
        for name, text in templates.items():
            words = self.hasher.words(plain(text.encode()))
            if len(words) < WIDTH:
                raise ValueError(f"template {name!r} has fewer than {WIDTH} words")
            width = len(words) - WIDTH + 1
            # a window of one shingle is the same as the template or shares nothing with it
            bands, rows = (1, 1) if width == 1 else (BANDS, ROWS)
            step = max(1, len(words) // 8)
            index = self.classes.setdefault(width, (bands, rows, step, {}))[3]
            minima = coordinates(self.hasher.shingles(words), bands * rows).min(axis=1, keepdims=True)
            for key in keys(minima, width, bands)[:, 0].tolist():
                index.setdefault(key, set()).add(name)
        self.sorted = {width: np.array(sorted(index), np.uint64) for width, (*_, index) in self.classes.items()}
        self.rough = {width: np.bincount(x.astype(np.int64) & 0xFFFF, minlength=1 << 16) > 0 for width, x in self.sorted.items()}
        own = [self.hasher.shingles(self.hasher.words(plain(text.encode()))) for text in templates.values()]
        self.shingles = np.unique(np.concatenate(own))
        self.marked = np.zeros(1 << 16, bool)
        self.marked[(self.shingles & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.reach = max(self.classes) + WIDTH - 1
        self.most = max(bands * rows for bands, rows, *_ in self.classes.values())

    def shares(self, shingles: np.ndarray) -> bool:
        """Whether any shingle is one of a template's: without one, no window can contain three quarters of a template."""
        near = shingles[self.marked[(shingles & np.uint64(0xFFFF)).astype(np.int64)]]
        place = np.minimum(np.searchsorted(self.shingles, near), len(self.shingles) - 1)
        return bool((self.shingles[place] == near).any())

    def candidates(self, words: np.ndarray) -> set[tuple[str, int, int]]:
        """Template, first word and number of words of every window that shares a band with it."""
        found, shingles = set(), self.hasher.shingles(words)
        if len(words) < WIDTH or not self.shares(shingles):
            return found
        values = coordinates(shingles, self.most)
        for width, (bands, rows, step, index) in self.classes.items():
            if width > len(shingles):
                continue
            starts = np.unique(np.append(np.arange(0, len(shingles) - width + 1, step), len(shingles) - width))
            own = keys(window_minima(values[: bands * rows], width, starts), width, bands)
            band, at = np.nonzero(self.rough[width][(own & np.uint64(0xFFFF)).astype(np.int64)])
            hits = own[band, at]
            place = np.minimum(np.searchsorted(self.sorted[width], hits), len(self.sorted[width]) - 1)
            for i in np.flatnonzero(self.sorted[width][place] == hits):
                for name in index[int(hits[i])]:
                    found.add((name, int(starts[at[i]]), width + WIDTH - 1))
        return found

    def scan(self, text: bytes | None) -> list[dict]:
        """Places of templates in a text, in word numbers, overlapping ones of a template joined."""
        norm = plain(text)
        hashes, words = self.hasher.words(norm), norm.split(b" ") if norm else []
        found: dict[str, list[list]] = {}
        for begin in range(0, max(1, len(words)), STRETCH):
            for name, start, length in sorted(self.candidates(hashes[begin : begin + STRETCH + 2 * self.reach])):
                step = self.classes[length - WIDTH + 1][2]
                first, last = max(0, begin + start - step), min(len(words), begin + start + length + step)
                around = shingle_set(b" ".join(words[first:last]))
                share = len(around & self.sets[name]) / len(self.sets[name])
                if share < CONTAINED:
                    continue
                places = found.setdefault(name, [])
                if places and first <= places[-1][1]:
                    places[-1][1:] = [max(last, places[-1][1]), max(share, places[-1][2])]
                else:
                    places.append([first, last, share])
        return [
            {"license": name, "first": a, "last": b, "share": share} for name in sorted(found) for a, b, share in found[name]
        ]


FOUND = "array<struct<license:string,first:int,last:int,share:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with the places of the templates in ``text``: name, words from and to (about), share of the template found.

    Rows stay as they are; a null text, and one of fewer than five words, has none. A column named like ``into`` is replaced.
    """
    kind = T.StructType.fromDDL(f"x {FOUND}")["x"].dataType
    arrow = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("share", pa.float64())]))

    def start() -> Callable[[pa.Array], pa.Array]:
        scanner = Scanner(templates)
        return lambda values: pa.array([scanner.scan(value.as_py()) for value in values], arrow)

    return with_mapped(docs, text, into, kind, start)


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: the licenses found, comma-joined by name, the number of places and the smallest share."""
    found = scan_licenses(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_places"),
        F.array_min("licenses.share").alias("least_share"),
    )
