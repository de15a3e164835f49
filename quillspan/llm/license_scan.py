"""License scans: an exact set-similarity join of text blocks with license templates, beside a scan for fixed phrases.

A template meets a block when the block holds at least `threshold` of the template's distinct words (containment).
The join is exact and uses the three filters of prefix joins. Template words are ordered by how many blocks of the whole
corpus hold them, rarest first (one counting pass). With o = ceil(threshold * |T|) words needed, a block that meets T
must hold one of T's |T| - o + 1 rarest words (prefix), must have o words or more (length), and from the first shared
word on there must be o words left in T and in the block's own template words (position). Survivors are counted in full.

A block is a paragraph (lines up to an empty line) and, where a paragraph has several lines, each of its lines.
Templates are a parameter; their words (a few hundred, whatever the corpus) are all that reaches the driver and the
executors. Each text is scanned in its own row, so hot sources and copies need no shuffle.

Null texts count as empty, and empty texts give no words, no labels and a score of 0. Repeated rows give repeated results.
Input columns that share a name with a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Phrases, as their words, and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The words by which licenses announce themselves.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc": "licensed under a creative commons attribution license",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8

#: Words are runs of digits, letters and all that is not ASCII; A-Z become a-z, any other ASCII character parts words.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_FOLD_IN_LINES = bytes(10 if c == 10 else _FOLD[c] for c in range(256))
_PARAGRAPH = re.compile(rb"\n *\n")


def _words(phrase: str) -> tuple[bytes, ...]:
    return tuple(phrase.encode().translate(_FOLD).split())


def blocks(text: bytes) -> Iterator[list[bytes]]:
    for paragraph in _PARAGRAPH.split(text.translate(_FOLD_IN_LINES)):
        lines = [words for line in paragraph.split(b"\n") if (words := line.split())]
        if len(lines) > 1:
            yield [w for line in lines for w in line]
        yield from lines


class Matcher:
    """The templates under one global order of their words."""

    def __init__(self, templates: dict[str, str], threshold: float, frequency: dict[bytes, int]):
        sets = {label: set(_words(t)) for label, t in templates.items()}
        order = sorted({w for s in sets.values() for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.vocabulary = frozenset(order)
        self.templates = []
        self.by_prefix: dict[int, list[tuple[int, int]]] = {}
        for label, s in sets.items():
            ranks = sorted(self.rank[w] for w in s)
            needed = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            for place, r in enumerate(ranks[: len(ranks) - needed + 1]):
                self.by_prefix.setdefault(r, []).append((len(self.templates), place))
            self.templates.append((label, frozenset(ranks), needed))

    def search(self, words: list[bytes]) -> dict[str, float]:
        """label: containment, for every template that the block meets."""
        have = self.vocabulary.intersection(words)
        if not have:
            return {}
        ranks = sorted(self.rank[w] for w in have)
        seen: set[int] = set()
        found = {}
        for place, r in enumerate(ranks):
            for t, at in self.by_prefix.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # this is the first word they share, in the global order
                label, template, needed = self.templates[t]
                if len(ranks) < needed or min(len(template) - at, len(ranks) - place) < needed:
                    continue
                shared = len(template.intersection(ranks))
                if shared >= needed:
                    found[label] = shared / len(template)
        return found


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively; places may overlap."""
    line = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in phrases.items():
        sought = b" " + b" ".join(_words(phrase)) + b" "
        at, before, counted = line.find(sought), 0, 0
        while at >= 0:
            before += line.count(b" ", counted, at)
            counted = at
            places.append((before, label))
            at = line.find(sought, at + 1)
    return places


def template_frequency(df: DataFrame, text: str, templates: dict[str, str]) -> dict[bytes, int]:
    """How many blocks of the whole corpus hold each template word: at most one number per word of the templates."""
    vocabulary = frozenset(w for t in templates.values() for w in _words(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                for block in blocks((t.as_py() or "").encode()):
                    total.update(vocabulary.intersection(block))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    counts = scratch.map_batches(df.select(F.col(f"`{text}`")), count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(w): n for w, n in counts.collect()}


def scan_licenses(df: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """df without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score (the best containment; 1 where a phrase stands)."""
    frequency = template_frequency(df, text, templates)
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rest = [c for c in df.columns if c.lower() != text.lower() and c.lower() not in own]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold, frequency)
        for batch in batches:
            rows = []
            for t in batch.column(0):
                raw = (t.as_py() or "").encode()
                words = raw.translate(_FOLD).split()
                places = phrase_places(words, phrases) if words else []
                met: dict[str, float] = {}
                for block in blocks(raw):
                    for label, share in matcher.search(block).items():
                        met[label] = max(share, met.get(label, 0.0))
                starts, base = [p for p, _ in places], {x for _, x in places}
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(met))), 1.0 if base else max(met.values(), default=0.0)))
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + arrays, names=rest + own)

    kept = df.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in rest])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]] + ["n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"])
    return scratch.map_batches(kept, scan, schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
