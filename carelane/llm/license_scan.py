"""License scans: an exact set-similarity join of licence templates with the blocks of every text.

A text's words are runs of letters and digits, A-Z folded. A template of n words is looked for in blocks of
the least power of two words that is at least 2 n (and ``LEAST_BLOCK``); a block begins each half of that, so
every n words in a row stand whole in a block. A template and a block match when the block has at least
``percent`` hundredths of the template's distinct words (containment).

One pass counts in how many documents each word of the templates occurs; by that, rare words first, all sets
are ordered. A second pass joins: only blocks with a word of a template's prefix are candidates (a set that
lacks all of these lacks too many), a block must have enough words of templates at all (length), and where
their first common words stand in both must leave enough words to come (position); what is left is counted
exactly. Templates are few (``MOST_TEMPLATE_WORDS``), so they travel to the tasks; no text is shuffled.

Beside the templates, fixed phrases of consecutive words give base labels.

Defined results: null and empty texts have no words; repeated rows get equal results; rows without doc_id keep
it null; templates without a word match nothing; more template words than ``MOST_TEMPLATE_WORDS`` are an error;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textbatch import slices

#: Fixed labels and their phrases.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Fixed notices of public licences, each under its label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "Licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]
#: Least share of a template's words in hundredths, least block, most template words.
PERCENT, LEAST_BLOCK, MOST_TEMPLATE_WORDS = 90, 16, 200_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of folded bytes, and the first word of each text."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[:n] = _WORD[data]
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | new))
    ends = np.flatnonzero(before & (~word | new))
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(text: str) -> list[bytes]:
    data = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends, _ = word_places(data, np.array([0, len(data)]))
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


class Vocabulary:
    """Numbers of some words; a text's words are looked up by two numbers of their bytes, then byte by byte."""

    def __init__(self, words: list[bytes]):
        self.words = sorted(set(words))
        self.number = {w: i for i, w in enumerate(self.words)}
        self.width = max(map(len, self.words), default=1)
        self.bytes = np.zeros((len(self.words), self.width), np.uint8)
        for i, w in enumerate(self.words):
            self.bytes[i, : len(w)] = np.frombuffer(w, np.uint8)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        every = self._heads(self.bytes.reshape(-1), np.arange(len(self.words)) * self.width, self.sizes)
        # Words of an equal head are a run in this order.
        self.heads, self.run = np.unique(every), np.argsort(every, kind="stable")
        self.run_at, self.run_end = (np.searchsorted(every[self.run], self.heads, side=side) for side in ("left", "right"))

    @staticmethod
    def _heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A word's first seven bytes and its length (255 for more) as one number."""
        head = np.minimum(sizes, 255).astype(np.uint64)
        for k in range(7):
            at = np.flatnonzero(sizes > k)
            head[at] |= data[starts[at] + k].astype(np.uint64) << np.uint64(8 * (k + 1))
        return head

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.words):
            return out
        sizes = ends - starts
        short = np.flatnonzero(sizes <= self.width)
        head = self._heads(data, starts[short], sizes[short])
        at = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        hit = self.heads[at] == head
        short, at = short[hit], at[hit]
        for turn in range(int((self.run_end - self.run_at).max())):
            more = self.run_at[at] + turn < self.run_end[at]
            short, at = short[more], at[more]
            number = self.run[self.run_at[at] + turn]
            same = sizes[short] == self.sizes[number]
            for k in range(7, self.width):
                check = np.flatnonzero(same & (sizes[short] > k))
                if not len(check):
                    break
                same[check] = data[starts[short[check]] + k] == self.bytes[number[check], k]
            out[short[same]] = number[same]
        return out


class Plan:
    """Templates as sets ordered by the frequency of their words, by block size, with an index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], percent: int, vocabulary: Vocabulary, frequency: np.ndarray):
        rank = np.empty(len(frequency), np.int64)
        rank[np.lexsort((np.arange(len(frequency)), frequency))] = np.arange(len(frequency))
        self.rank, self.sets, self.least = rank, [], []
        self.classes: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, (_, text) in enumerate(templates):
            words = words_of(text)
            own = sorted({int(rank[vocabulary.number[w]]) for w in words})
            need = -(-percent * len(own) // 100)
            self.sets.append(np.array(own, np.int64))
            self.least.append(need)
            for i, r in enumerate(own[: len(own) - need + 1]):
                self.classes.setdefault(block_size(len(words)), {}).setdefault(r, []).append((t, i))
        self.begins = {size: np.isin(np.arange(len(rank)), list(index)) for size, index in self.classes.items()}

    def matches(self, ranks: np.ndarray, places: np.ndarray, n_words: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word and end of the block, words found) of one text, from its words that templates have."""
        for size, index in self.classes.items():
            half = size // 2
            last = max(0, -(-n_words // half) - 2)
            block = places[self.begins[size][ranks]] // half
            if not len(block):
                continue
            for b in np.unique(np.concatenate([np.minimum(block, last), np.clip(block - 1, 0, last)])):
                inside = np.unique(ranks[slice(*np.searchsorted(places, [b * half, b * half + size]))])
                asked = set()
                for j, r in enumerate(inside.tolist()):
                    for t, i in index.get(r, ()):
                        if t in asked:
                            continue
                        asked.add(t)
                        own, need = self.sets[t], self.least[t]
                        # Length, then position: r is the first word that both have, as all before were looked up, too.
                        if len(inside) < need or 1 + min(len(own) - i - 1, len(inside) - j - 1) < need:
                            continue
                        found = len(np.intersect1d(own, inside, assume_unique=True))
                        if found >= need:
                            yield t, int(b * half), int(min(b * half + size, n_words)), found


def block_size(n: int) -> int:
    return max(LEAST_BLOCK, 1 << (2 * n - 1).bit_length())


def document_frequency(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """In how many texts of the whole table each word occurs; a number a word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(0)):
                data = _FOLD[data]
                starts, ends, at = word_places(data, offsets)
                number = vocabulary.look_up(data, starts, ends)
                hit = np.flatnonzero(number >= 0)
                doc = np.searchsorted(at, hit, side="right") - 1
                both = np.unique(doc * len(count) + number[hit])
                count += np.bincount(both % max(1, len(count)), minlength=len(count)) if len(both) else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count)), pa.int32()), pa.array(count)], names=["word", "n"])

    out = np.zeros(len(vocabulary.words), np.int64)
    if len(out):
        for r in docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            out[r["word"]] = r["n"]
    return out


_FOUND = "n_words long, phrases array<struct<phrase:int,word:bigint>>, matches array<struct<template:int,first:bigint,end:bigint,words:int,score:double>>"
_PHRASES = pa.list_(pa.struct([("phrase", pa.int32()), ("word", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int64()), ("end", pa.int64()), ("words", pa.int32()), ("score", pa.float64())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, phrases (number, start word) and matches (template, block's first word and end, words found,
    containment) of every text of documents (doc_id, text)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    phrase_words = [words_of(p) for _, p in phrases]
    template_words = [words_of(text) for _, text in templates]
    if sum(map(len, template_words)) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"at most {MOST_TEMPLATE_WORDS} words in all templates")
    vocabulary = Vocabulary([w for ws in phrase_words + template_words for w in ws])
    named = [i for i, ws in enumerate(template_words) if ws]
    plan = Plan([templates[i] for i in named], percent, vocabulary, document_frequency(docs, vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, plan, [[vocabulary.number[w] for w in ws] for ws in phrase_words]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, plan, looked = shared.value
        for batch in batches:
            counts, places, found = [], [], []
            for lo, hi, data, offsets in slices(batch.column(1)):
                data = _FOLD[data]
                starts, ends, at = word_places(data, offsets)
                number = vocabulary.look_up(data, starts, ends)
                hit = np.flatnonzero(number >= 0)
                doc_end = at[1:]
                begun = []
                for p, ws in enumerate(looked):
                    where = hit[number[hit] == ws[0]] if ws else hit[:0]
                    for k, w in enumerate(ws):
                        where = where[where + k < len(number)]
                        where = where[number[where + k] == w]
                    doc = np.searchsorted(at, where, side="right") - 1
                    inside = where + len(ws) <= doc_end[doc] if len(where) else np.zeros(0, bool)
                    begun += [(int(d), p, int(w)) for d, w in zip(doc[inside], where[inside], strict=True)]
                by_doc = defaultdict(list)
                for d, p, w in begun:
                    by_doc[d].append({"phrase": p, "word": w - int(at[d])})
                cut = np.searchsorted(hit, at)
                for k in range(hi - lo):
                    mine = hit[cut[k] : cut[k + 1]]
                    n = int(at[k + 1] - at[k])
                    counts.append(n)
                    places.append(sorted(by_doc.get(k, []), key=lambda x: (x["word"], x["phrase"])))
                    got = plan.matches(plan.rank[number[mine]], mine - at[k], n) if len(mine) else ()
                    found.append([{"template": named[t], "first": a, "end": b, "words": x, "score": x / len(plan.sets[t])} for t, a, b, x in sorted(got)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, _PHRASES), pa.array(found, _MATCHES)], names=["doc_id", "n_words", "phrases", "matches"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {_FOUND}")


def labelled(scanned: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from ``scan``.

    The score is 1 with a base phrase, else the greatest containment of a match, else 0.
    """
    named = lambda items: F.array(*[F.lit(label) for label, _ in items]) if items else F.array().cast("array<string>")
    base = F.array_distinct(F.transform("phrases", lambda p: F.get(named(phrases), p["phrase"])))
    more = F.array_distinct(F.transform("matches", lambda m: F.get(named(templates), m["template"])))
    words = F.transform("phrases", lambda p: p["word"])
    score = F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"), score.alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return labelled(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _sql() -> str:
    """The same by counting every block against every template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    texts = lambda items: ", ".join(f"({quote(label)}, {quote(' '.join(w.decode() for w in words_of(text)))})" for label, text in items)
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
ph as (select l label, string_split(p, ' ') ps from (values {texts(PHRASES)}) v(l, p)),
b as (select doc_id, label, i - 1 as pos from (select doc_id, label, ws, ps, unnest(range(1, len(ws) - len(ps) + 2)) i from w, ph) where ws[i:i + len(ps) - 1] = ps),
bs as (select doc_id, count(*) n_base, min(pos) first_word, max(pos) last_word, list(distinct label) ls from b group by doc_id),
t as (select l label, len(string_split(p, ' ')) n, list_distinct(string_split(p, ' ')) s from (values {texts(TEMPLATES)}) v(l, p)),
tc as (select *, greatest({LEAST_BLOCK}, pow(2, ceil(log2(2 * n)))::bigint) size from t),
bl as (select doc_id, size, list_distinct(ws[j * size // 2 + 1:j * size // 2 + size]) u from (select doc_id, ws, size, unnest(range(0, greatest(1, (2 * len(ws) + size - 1) // size - 1))) j from w, (select distinct size from tc) where len(ws) > 0)),
m as (select doc_id, label, len(list_intersect(u, s)) / len(s) as score from bl join tc using (size) where 100 * len(list_intersect(u, s)) >= {PERCENT} * len(s)),
ms as (select doc_id, list(distinct label) ls, max(score) score from m group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(list_sort(bs.ls), ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.ls, []), coalesce(ms.ls, [])))), ','), '') as labels,
 case when n_base > 0 then 1.0::double else coalesce(ms.score, 0.0)::double end as score
from w left join bs on w.doc_id is not distinct from bs.doc_id left join ms on w.doc_id is not distinct from ms.doc_id
"""


SQL = _sql()
