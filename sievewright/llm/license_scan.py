"""License scans by patience alignment of texts with license templates.

A template can only be covered where its words are dense: a window a quarter longer than the template must hold enough
of them, which one running sum a template finds for all texts of a slice. There the words that occur once in the
window and once in the template are anchors; the longest increasing subsequence of their places is kept, and the gaps
between anchors are aligned in the same way, ends growing over equal words, until no anchor is left. The share of
template words that are matched is the coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, arrow_map, ids_and_texts, slices
from .decontamination import _words

#: Templates under SHORT words must be covered wholly: four words of five are many a license's.
MIN_COVERAGE, STRETCH, SHORT = 0.8, 1.25, 8
_BITS = 20

TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-short": "Licensed under the MIT license.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "Copyright. All rights reserved.",
}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs by first place, whose second places rise: patience sorting."""
    tops, links, piles = [], [], []
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        links.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[p], piles[p] = y, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = links[k]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (in the text, in the template), rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c)}
        anchors = _rising([(i, place[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and there.get(w) == 1])
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(found)


def _scan(names: list[str], texts: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = _words(pa.array(texts, pa.string()))
        templates = [words[first[k] : first[k + 1]] for k in range(len(texts))]
        member = np.zeros(1 << _BITS, np.uint64)
        for k, t in enumerate(templates):
            member[t >> U64(64 - _BITS)] |= U64(1 << k)
        for b in slices(batches):
            h, start = _words(b.column("text"))
            bits = member[h >> U64(64 - _BITS)]
            rows = []
            for k, t in enumerate(templates):
                if not len(t) or not len(h):
                    continue
                need = len(t) if len(t) < SHORT else int(np.ceil(MIN_COVERAGE * len(t) - 1e-9))
                width = int(np.ceil(STRETCH * len(t)))
                total = np.concatenate([[0], np.cumsum((bits >> U64(k)) & U64(1), dtype=np.int64)])
                dense = np.flatnonzero(total[np.minimum(np.arange(len(h)) + width, len(h))] - total[:-1] >= need)
                done = -1
                for p in dense.tolist():
                    if p < done:
                        continue
                    d = int(np.searchsorted(start, p, "right")) - 1
                    window = h[p : min(p + width, start[d + 1])]
                    if window[0] not in t:  # an alignment begins with a matched word
                        continue
                    got = align(window.tolist(), t.tolist())
                    if len(got) >= need:
                        done = p + got[-1][0] + 1
                        rows.append((d, k, p + got[0][0] - start[d], done - start[d], len(got) / len(t)))
            ids = b.column("doc_id").to_pylist()
            columns = [[ids[r[0]] for r in rows], [names[r[1]] for r in rows], [int(r[2]) for r in rows], [int(r[3]) for r in rows], [r[4] for r in rows]]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "license", "start", "end", "coverage"])

    return run


def spans(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start, end, coverage): the word spans that cover a template by MIN_COVERAGE or more, a short one wholly.

    Up to 64 templates, a fixed table. Spans of one template don't overlap; each begins with a matched word.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > 64:
        raise ValueError("at most 64 templates")
    return arrow_map(ids_and_texts(docs), _scan(list(templates), list(templates.values())), "doc_id long, license string, start int, end int, coverage double")


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_spans, coverage, first_start): one row for each document and template found in it.

    Null and empty texts have no licenses. Rows that share a doc_id are pooled, null doc_ids among themselves.
    """
    found = spans(docs, templates).groupBy("doc_id", "license")
    return found.agg(F.count(F.lit(1)).alias("n_spans"), F.max("coverage").alias("coverage"), F.min("start").cast("long").alias("first_start"))
