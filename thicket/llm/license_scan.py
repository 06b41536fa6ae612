"""License scans by an exact set-similarity join: tokens ordered by global frequency, with prefix, length and
positional filters, find every text block that meets the template containment threshold."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import lean, plain, table, utf8

#: Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short public license notices and grants, by label.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-notice": "Released under the MIT License.",
}

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; UTF-8 letters keep their bytes."""
    return text.translate(_KEEP).split() if text else []


def blocks(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Windows of 2 * width words, width apart: any run of at most width words stands whole in one."""
    for start in range(0, max(1, n - width), width):
        yield start, min(n, start + 2 * width)


class Index:
    """Templates as sets in global frequency order, with an inverted list of the tokens of their prefixes.

    A block holds at least the share `least` of a template's set only if they share `need` tokens.  The template's
    prefix, its size - need + 1 rarest tokens, then holds one of the block's.  The blocks of a template are of twice
    its own number of words.
    """

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], least: float) -> None:
        self.least, self.sets, self.need, self.width = least, {}, {}, {}
        rank = lambda w: (frequency.get(w, 0), w)
        self.lists: dict[bytes, list[tuple[str, int]]] = {}
        for label, text in sorted(templates.items()):
            tokens = sorted(set(words(text.encode())), key=rank)
            if not tokens:
                continue
            need = max(1, math.ceil(least * len(tokens) - 1e-9))
            self.sets[label], self.need[label], self.width[label] = tokens, need, len(words(text.encode()))
            for place in range(len(tokens) - need + 1):
                self.lists.setdefault(tokens[place], []).append((label, place))
        self.prefix = frozenset(self.lists)

    def met(self, found: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, containment) of every block of a text that meets its template.

        Only blocks with a token of the template's prefix are looked at, from the first of those on in its order."""
        if self.prefix.isdisjoint(found):
            return []
        first: dict[tuple[str, int], int] = {}  # label and number of the block: place of the first shared token
        for at, token in enumerate(found):
            for label, place in self.lists.get(token, ()):
                k = at // self.width[label]
                for key in ((label, k - 1), (label, k)):
                    first[key] = min(place, first.get(key, place))
        n, out = len(found), []
        for (label, k), place in first.items():
            width, need, tokens = self.width[label], self.need[label], self.sets[label]
            a = k * width
            if not 0 <= a < max(1, n - width):  # no block begins there
                continue
            b = min(n, a + 2 * width)
            if b - a < need or len(tokens) - place < need:  # by length; by position
                continue
            block = set(found[a:b])
            shared = sum(t in block for t in tokens[place:])
            if shared >= need:
                out.append((label, a, b, shared / len(tokens)))
        return sorted(out)

    def scores(self, block: frozenset[bytes]) -> dict[str, float]:
        """Every template that the block meets, with its containment."""
        first: dict[str, int] = {}
        for token in self.prefix & block:
            for label, place in self.lists[token]:
                first[label] = min(place, first.get(label, place))
        out = {}
        for label, place in first.items():
            tokens, need = self.sets[label], self.need[label]
            if len(block) < need or len(tokens) - place < need:  # by length; by position: none of the tokens before the first shared one counts
                continue
            shared = sum(t in block for t in tokens[place:])
            if shared >= need:
                out[label] = shared / len(tokens)
        return out


def _base(found: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
    """Places where a phrase's words stand one after another: how many, the first, the last, and the labels."""
    n, first, last, labels = 0, None, None, set()
    for phrase, label in PHRASES.items():
        parts = [p.encode() for p in phrase.split()]
        at = -1
        while True:
            try:
                at = found.index(parts[-1], at + 1)
            except ValueError:
                break
            start = at - len(parts) + 1
            if start >= 0 and found[start : at + 1] == parts:
                n, labels = n + 1, labels | {label}
                first = start if first is None else min(first, start)
                last = start if last is None else max(last, start)
    return n, first, last, labels


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
BLOCKS = "blocks array<struct<label: string, first_word: int, end_word: int, containment: double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text: str = "text") -> DataFrame:
    """One row for each document: the places of the base phrases, the labels of the templates of which some block of
    the text holds at least the share `least` of the words, and all blocks that do.

    Two passes over whole texts: the first counts the places of each template word, which gives the frequency order;
    the second joins.  Counts and templates are bounded by the templates, so both are sent to the tasks.  A block is
    twice its template; blocks overlap by half, and adjacent ones may both meet it.  score is the largest containment
    of a template that was met, 1 where only a phrase was found, else 0.  Null and empty texts have no words and
    no labels.  Repeated rows give repeated results.  Columns other than doc_id and the text are not read.  An empty
    table gives no rows; a template without words is never met.
    """
    lean(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    vocabulary = frozenset(w for t in templates.values() for w in words(t.encode()))
    tails = tuple(phrase.split()[-1].encode() for phrase in PHRASES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for raw in utf8(batch.column(0)):
                found = words(raw)
                if not vocabulary.isdisjoint(found):
                    seen.update(filter(vocabulary.__contains__, found))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    both = plain(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")))
    counted = both.select("c1").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    index = Index(templates, {r["word"].encode(): r["n"] for r in counted.collect()}, least)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]
    block = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("containment", pa.float64())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for raw in utf8(batch.column(1)):
                found = words(raw)
                low = raw.lower() if raw else b""
                n, first, last, base = _base(found) if any(t in low for t in tails) else (0, None, None, set())
                met = index.met(found)
                labels = base | {label for label, _, _, _ in met}
                row = (len(found), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max((m[3] for m in met), default=float(n > 0)))
                for to, value in zip(out, (*row, [dict(zip(("label", "first_word", "end_word", "containment"), m, strict=True)) for m in met]), strict=True):
                    to.append(value)
            arrays = [batch.column(0), *(pa.array(x, t) for x, t in zip(out, [*types[1:], block], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "blocks"])

    return both.mapInArrow(join, f"{SCHEMA}, {BLOCKS}")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(*(c.split()[0] for c in SCHEMA.split(", ")), F.size("blocks").cast("long").alias("n_blocks"))
