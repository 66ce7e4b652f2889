"""License scan: phrases, and an exact set-similarity join of text blocks with templates.

The join: tokens are ordered by their frequency over the whole corpus, rarest first.
A template T matches a block B when ``|B & T| >= t * |T|`` on distinct words. Then B
must hold one of the first ``|T| - ceil(t * |T|) + 1`` words of T in that order (prefix
filter), have at least ``ceil(t * |T|)`` distinct words (length filter), and enough of T's words must be
left from the first shared one on (positional filter). The filters lose no match; what passes is counted exactly.

A notice that is wrapped over lines is in no line alone. So the same share is also looked for in windows of
words that don't stop at line breaks, with the same prefix filter and exact counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, TextBatch, bound_batches, hash_words, text_or_empty, text_pieces

#: Phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label and the words of a notice, in the usual public wording.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "Copyright. All rights reserved."),
)
#: A block matches where it holds this share of a template's distinct words.
CONTAINMENT = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    tokens: np.ndarray  # distinct word hashes, rarest in the corpus first
    need: int  # words that must be shared
    span: int  # words of a window across lines: the template's, with room for some others

    @property
    def prefix(self) -> np.ndarray:
        return self.tokens[: len(self.tokens) - self.need + 1]


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    found = []
    for label, text in templates:
        batch = TextBatch(pa.array([text]), NON_ALNUM)
        data = batch.data.tobytes()
        words = [data[s:e].decode() for s, e in zip(batch.starts, batch.ends, strict=True)]
        found.append((label, list(dict.fromkeys(words))))
    return found


def template_frequencies(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """How often each template word occurs in the whole corpus: one row per task and word
    is all that is shuffled, so the result is as small as the templates."""
    vocabulary = np.sort(hash_words(words, NON_ALNUM))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for piece in text_pieces(batch, 0):
                hashes = TextBatch(piece.column(0), NON_ALNUM).hashes()
                where, hit = _lookup(vocabulary, hashes)
                total += np.bincount(where[hit], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], names=["word", "n"])

    rows = docs.select(text_or_empty(text).alias(text)).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_hash = {r["word"]: r["n"] for r in rows}
    return {w: by_hash.get(int(h), 0) for w, h in zip(words, hash_words(words, NON_ALNUM).view(np.int64), strict=True)}


def _lookup(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into the sorted table, and whether the value is there. A bitmap over 16 bits
    of the hash settles nearly all values without a search."""
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(table >> np.uint64(48)).astype(np.int64)] = True
    some = np.flatnonzero(maybe[(values >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, values[some]), len(table) - 1)
    where = np.zeros(len(values), dtype=np.int64)
    hit = np.zeros(len(values), dtype=bool)
    where[some] = at
    hit[some] = table[at] == values[some]
    return where, hit


def ordered_templates(frequencies: dict[str, int], templates=TEMPLATES, containment: float = CONTAINMENT) -> list[Template]:
    out = []
    for (label, words), (_, text) in zip(template_words(templates), templates, strict=True):
        words = sorted(words, key=lambda w: (frequencies.get(w, 0), w))
        span = math.ceil(len(TextBatch(pa.array([text]), NON_ALNUM).starts) / containment)
        out.append(Template(label, hash_words(words, NON_ALNUM), max(1, math.ceil(containment * len(words) - 1e-9)), span))
    return out


def block_matches(words: np.ndarray, templates: list[Template], candidates: list[int]) -> list[tuple[int, int]]:
    """(template, shared words) of one block's word hashes, for the templates that pass all filters."""
    own = np.unique(words)
    found = []
    for k in candidates:
        t = templates[k]
        if len(own) < t.need:
            continue  # length filter
        present = np.isin(t.tokens, own)
        first = int(np.argmax(present))
        if not present[first] or len(t.tokens) - first < t.need:
            continue  # positional filter: too few words are left from the first shared one on
        if (shared := int(present.sum())) >= t.need:
            found.append((k, shared))
    return found


def wrapped_matches(h: np.ndarray, first: np.ndarray, line_first: np.ndarray, t: Template) -> list[tuple[int, int, int]]:
    """(first word, words, shared words) of the windows of at most ``span`` words of one text that hold
    enough of the template's and go over a line break. Windows that begin side by side
    are one match, the best of them. ``first`` and ``line_first``: first words of texts and lines."""
    seeds = np.flatnonzero(np.isin(h, t.prefix))
    if not len(seeds):
        return []
    doc = np.searchsorted(first, seeds, side="right") - 1
    cover = np.zeros(len(h) + 1, dtype=np.int64)  # prefix filter: only words near one of the prefix
    np.add.at(cover, np.maximum(first[doc], seeds - t.span + 1), 1)
    np.add.at(cover, np.minimum(first[doc + 1], seeds + t.span), -1)
    near = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    order = np.argsort(t.tokens)
    at = np.minimum(np.searchsorted(t.tokens[order], h[near]), len(order) - 1)
    own = t.tokens[order][at] == h[near]
    place, token = near[own], at[own]
    # A word counts for the windows that begin after the same word's last place, up to itself.
    by_token = np.lexsort((place, token))
    again = np.zeros(len(place), dtype=np.int64)
    same = token[by_token][1:] == token[by_token][:-1]
    again[by_token[1:]] = np.where(same, place[by_token][:-1] + 1, 0)
    begin = np.maximum(np.maximum(again, place - t.span + 1), first[np.searchsorted(first, place, side="right") - 1])
    change = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, place + 1, -1)
    shared = np.cumsum(change[:-1])
    good = np.flatnonzero(shared >= t.need)
    # Only windows that begin with a word of the template: the others are such a window with words before it.
    good = good[np.isin(good, place)]
    last = place[np.searchsorted(place, good + t.span, side="left") - 1]
    last = np.minimum(last, place[np.searchsorted(place, first[np.searchsorted(first, good, side="right")], side="left") - 1])
    over = np.searchsorted(line_first, good, side="right") != np.searchsorted(line_first, last, side="right")
    good, last = good[over], last[over]
    found: list[tuple[int, int, int]] = []
    end = -1
    for g, z in zip(good.tolist(), last.tolist(), strict=True):
        match = (g, z - g + 1, int(shared[g]))
        if g > end:
            found.append(match)
        elif match[2] > found[-1][2]:
            found[-1] = match
        end = max(end, z)
    return found


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks, wrapped: a row per input row.

    A block is a line of the text, or a window of words that goes over line breaks. ``score`` is the best containment of a matched template,
    1 where a phrase stands, else 0. ``blocks`` lists (label, first word, words, containment)
    of every matched line and template, ``wrapped`` those of windows. A null or empty text has no words, empty labels, null places
    and score 0. Repeated rows are judged alike; other columns are ignored. Two passes
    over the texts; only counts of template words are shuffled.
    """
    bound_batches(docs)
    words = sorted({w for _, ws in template_words(templates) for w in ws})
    ordered = ordered_templates(template_frequencies(docs, words, text), templates, containment)
    prefix_of: dict[int, list[int]] = {}
    for k, t in enumerate(ordered):
        for h in t.prefix:
            prefix_of.setdefault(int(h), []).append(k)
    prefix_table = np.sort(np.array(list(prefix_of), dtype=np.uint64))
    phrase_hashes = [(hash_words(p.split(), NON_ALNUM), label) for p, label in phrases]
    kind = docs.schema[key].dataType.simpleString()
    found = "array<struct<label:string,first_word:long,n_words:long,containment:double>>"
    schema = f"{key} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks {found}, wrapped {found}"
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks", "wrapped"]
    block_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))

    def part(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        batch = TextBatch(texts, NON_ALNUM)
        h = batch.hashes()
        n, first = batch.n, batch.first
        n_base = np.zeros(n, dtype=np.int64)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set[str]] = [set() for _ in range(n)]
        for hashes, label in phrase_hashes:
            at = np.flatnonzero(h[: max(0, len(h) - len(hashes) + 1)] == hashes[0])
            for j, x in enumerate(hashes[1:], 1):
                at = at[h[at + j] == x]
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + len(hashes) <= first[doc + 1]
            at, doc = at[inside], doc[inside]
            np.add.at(n_base, doc, 1)
            np.minimum.at(low, doc, at - first[doc])
            np.maximum.at(high, doc, at - first[doc])
            for d in np.unique(doc):
                labels[d].add(label)
        base = [",".join(sorted(x)) for x in labels]
        score = np.array([1.0 if x else 0.0 for x in labels])
        blocks: list[list[dict]] = [[] for _ in range(n)]
        line_starts = np.union1d(batch.bounds[:-1], np.flatnonzero(batch.data == 10) + 1)
        line_first = np.append(np.searchsorted(batch.starts, line_starts), len(h))
        _, hit = _lookup(prefix_table, h)
        at = np.flatnonzero(hit)
        line = np.searchsorted(line_first, at, side="right") - 1
        for b in np.unique(line):
            near = sorted({k for w in h[at[line == b]] for k in prefix_of[int(w)]}) if len(at) < 64 else sorted({k for w in h[line_first[b] : line_first[b + 1]][hit[line_first[b] : line_first[b + 1]]] for k in prefix_of[int(w)]})
            d = int(np.searchsorted(first, line_first[b], side="right") - 1)
            for k, shared in block_matches(h[line_first[b] : line_first[b + 1]], ordered, near):
                share = shared / len(ordered[k].tokens)
                labels[d].add(ordered[k].label)
                score[d] = max(score[d], share)
                blocks[d].append({"label": ordered[k].label, "first_word": int(line_first[b] - first[d]), "n_words": int(line_first[b + 1] - line_first[b]), "containment": share})
        wrapped: list[list[dict]] = [[] for _ in range(n)]
        for k in sorted({k for w in np.unique(h[at]) for k in prefix_of[int(w)]}):
            for begin, size, shared in wrapped_matches(h, first, line_first, ordered[k]):
                d = int(np.searchsorted(first, begin, side="right") - 1)
                share = shared / len(ordered[k].tokens)
                labels[d].add(ordered[k].label)
                score[d] = max(score[d], share)
                wrapped[d].append({"label": ordered[k].label, "first_word": int(begin - first[d]), "n_words": size, "containment": share})
        none = n_base == 0
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(batch.counts.astype(np.int64)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none), pa.array(base), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score), pa.array(blocks, block_type), pa.array(wrapped, block_type)],
            names=names,
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch, 1):
                yield part(piece.column(0), piece.column(1))

    return docs.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(scan, schema)
