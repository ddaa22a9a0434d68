"""License scans (3): patience alignment of texts with license templates.

Both sides are lower-cased words. A template is sought around each place of its rarest word in the text: words unique to
both sides are anchors, their longest increasing subsequence is kept, and the gaps between anchors are aligned in the same
way. Coverage is the share of the template's words that are aligned; a find has COVER or more. Finds go from left to right
and do not overlap; where notices stand close together, the one around the first place is sought before the next.

Null and empty texts have no finds, nor does an empty template. Repeated rows repeat their finds. Other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices

#: Least coverage, and words before and after the expected place, as a share of the template and at least.
COVER, SLACK, SLACK_WORDS = 0.8, 0.5, 4

# Notices and opening passages of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    ),
}
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Increasing pairs (i, j) with a[i] == b[j], by patience alignment; gaps wait on a stack, so depth is no limit."""
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, i_end, j, j_end = gaps.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        ours, theirs = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {b[k]: k for k in range(j, j_end) if theirs[b[k]] == 1}
        anchors = [(k, place[a[k]]) for k in range(i, i_end) if ours[a[k]] == 1 and a[k] in place]
        chain = _increasing(anchors)
        pairs += chain
        if chain:
            borders = [(i - 1, j - 1), *chain, (i_end, j_end)]
            gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(borders, borders[1:]) if p + 1 < q and r + 1 < s]
    return sorted(pairs)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing second parts; first parts increase already."""
    tops, ends, back = [], [], []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[at], ends[at] = j, n
        back.append(ends[at - 1] if at else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.counts, self.places = Counter(self.words), {w: i for i, w in reversed(list(enumerate(self.words)))}
        self.needed = COVER * len(self.words)

    def finds(self, words: list[str], counts: Counter):
        """(coverage, first word, words spanned) of each find, left to right, none overlapping."""
        present = [w for w in self.counts if w in counts]
        if not self.words or sum(self.counts[w] for w in present) < self.needed:
            return
        # The rarest words cover every find: a find lacks at most the words that coverage allows.
        spare = len(self.words) - self.needed
        rare, missing = [], 0
        for word in sorted(self.counts, key=lambda w: (counts[w], w)):
            rare.append(word)
            missing += self.counts[word]
            if missing > spare:
                break
        seeds = set(rare)
        slack = max(SLACK_WORDS, int(SLACK * len(self.words)))
        end = 0
        places: dict[str, list[int]] = {word: [] for word in seeds}
        for at, word in enumerate(words):
            if word in seeds:
                places[word].append(at)
        turn = dict.fromkeys(seeds, 0)
        for at, word in sorted((at, word) for word, own in places.items() for at in own):
            turn[word] += 1
            if at < end:
                continue
            start, stop = max(end, at - len(self.words) - slack), at + len(self.words) + slack
            # A window that ends before the seed comes once more than in the template holds no second copy of it.
            more = places[word][turn[word] + self.counts[word] - 1 :][:1]
            for limit in sorted({min([stop, *more]), stop}):
                pairs = _dense(align(self.words, words[start:limit]), 2 * len(self.words))
                if len(pairs) >= self.needed:
                    first, last = start + pairs[0][1], start + pairs[-1][1]
                    yield len(pairs) / len(self.words), first, last - first + 1
                    end = last + 1
                    break


def _dense(pairs: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The longest stretch of pairs whose text side spans at most `most` words."""
    best, low = (0, 0), 0
    for high in range(len(pairs)):
        while pairs[high][1] - pairs[low][1] >= most:
            low += 1
        if high + 1 - low > best[1] - best[0]:
            best = (low, high + 1)
    return pairs[slice(*best)]


def license_finds(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, coverage, first_word, n_words), one row per find."""
    texts = dict(templates if templates is not None else TEMPLATES)

    def run(batches):
        known = [Template(n, t) for n, t in texts.items()]
        vocabulary = set().union(*(t.counts for t in known))
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                counts = Counter(w for w in words if w in vocabulary)
                out += [(doc, t.name, *find) for t in known for find in t.finds(words, counts)]
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "coverage", "first_word", "n_words"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, first_word int, n_words int")
