"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a run of lines without a blank line between them. Its tokens, and a template's, are the distinct runs of three words. A
block is linked to a template if it holds at least the threshold's share of the template's tokens. Only tokens that some template has can
be shared, so blocks carry these alone. All tokens are ordered by how many blocks of the whole table hold them, rarest first. A template
with n tokens, of which k must be shared, is found by its first n - k + 1 tokens (the prefix filter): a Spark join of the blocks'
tokens with this index. Blocks with fewer than k tokens are left out (the length filter), as are pairs whose first shared
token stands so late in either order that k can't be reached (the positional filter). What is left is verified by the whole sets.

Base labels are those of phrases, wherever their words stand one behind another. The score is the greatest share of a template found,
1 where a phrase stands, else 0.

Null texts are empty; empty ones have no words, labels or places. Texts of any length are read whole. Rows that repeat, or share an id, get
a result each, and null ids stay null. An empty table gives an empty one. Only the id and text columns are read, whatever others
are named.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed, small_side
from corpuscle.llm.words import blocks, byte_class, cut, raw
from corpuscle.llm.worker import release

#: Share of a template's tokens that a block must hold; words of a token.
THRESHOLD, WORDS = 0.8, 3
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Labels and sentences of public licenses and of the usual references to them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("all-rights-reserved", "Copyright. All rights reserved. No part of this publication may be reproduced"),
)

_BLANK = re.compile(rb"\n[ \t\r\f\v]*(?=\n)")
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_FOLD))


class _Lexicon:
    """Numbers for the words of templates and phrases, and for the templates' tokens."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], width: int):
        lists = [words_of(t) for _, t in templates]
        if short := [t for w, (_, t) in zip(lists, templates, strict=True) if len(w) < width]:
            raise ValueError(f"templates of fewer than {width} words: {short}")
        self.width = width
        self.words = sorted({w for ws in (*lists, *(words_of(p) for p, _ in phrases)) for w in ws})
        of = {w: k for k, w in enumerate(self.words)}
        self.phrases = [([of[w] for w in words_of(p)], label) for p, label in phrases]
        runs = [[tuple(of[w] for w in ws[i : i + width]) for i in range(len(ws) - width + 1)] for ws in lists]
        self.tokens = sorted({r for rs in runs for r in rs})
        number = {r: k for k, r in enumerate(self.tokens)}
        self.templates = [sorted({number[r] for r in rs}) for rs in runs]


def _runs(words: np.ndarray, run: Sequence[int], room: np.ndarray) -> np.ndarray:
    """Where the words of a run stand one behind another in one text. room: words from each place to its text's end."""
    at = np.flatnonzero(words == run[0])
    for k, w in enumerate(run[1:], 1):
        at = at[room[at] > k]
        at = at[words[at + k] == w]
    return at


def _scanned(lexicon: _Lexicon, doc_id: str, text: str):
    """Of documents: words, places of phrases, and of each block the tokens that templates have."""
    table, named, width = byte_class(digits=True), pa.array(lexicon.words, pa.string()), lexicon.width
    tokens = np.array(lexicon.tokens, np.int64).reshape(-1, width)
    codes = np.zeros(len(tokens), np.int64)
    for k in range(width):
        codes = codes * len(lexicon.words) + tokens[:, k]  # in order, as tokens are

    def rows(t: pa.Table) -> pa.RecordBatch:
        data, ends = raw(t.column(text).combine_chunks())
        words, before, starts = cut(data, ends, table)
        w = pc.fill_null(pc.index_in(words, value_set=named), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n, count = t.num_rows, np.diff(before)
        doc = np.repeat(np.arange(n), count)
        room = before[1:][doc] - np.arange(len(w))
        found = [(_runs(w, run, room), label) for run, label in lexicon.phrases]
        places = np.sort(np.concatenate([at for at, _ in found])) if found else np.zeros(0, np.int64)
        n_base = np.bincount(doc[places], minlength=n)
        first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        last[doc[places]] = places - before[:-1][doc[places]]
        first[doc[places[::-1]]] = (places - before[:-1][doc[places]])[::-1]
        labels = [[] for _ in range(n)]
        for at, label in found:
            for d in np.unique(doc[at]).tolist():
                labels[d].append(label)
        # Runs of words of templates alone, by their codes; then their blocks.
        at = np.flatnonzero((w >= 0) & (room >= width))
        for k in range(1, width):
            at = at[w[at + k] >= 0]
        code = np.zeros(len(at), np.int64)
        for k in range(width):
            code = code * len(lexicon.words) + w[at + k]
        token = np.searchsorted(codes, code)
        known = codes[np.minimum(token, len(codes) - 1)] == code if len(codes) else np.zeros(len(code), bool)
        at, token = at[known], token[known]
        held: list[list[list[int]]] = [[] for _ in range(n)]
        edges = np.flatnonzero(np.r_[True, np.diff(doc[at]) != 0, True]) if len(at) else np.zeros(0, np.int64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d = int(doc[at[i]])
            blank = np.array([m.start() for m in _BLANK.finditer(data[ends[d] : ends[d + 1]].tobytes())], np.int64) + ends[d]
            of = np.searchsorted(blank, starts[at[i:j]])
            inside = of == np.searchsorted(blank, starts[at[i:j] + width - 1])
            of, own = of[inside], token[i:j][inside]
            held[d] = [np.unique(own[of == b]).tolist() for b in np.unique(of)]
        no_place = n_base == 0
        columns = [t.column(doc_id).combine_chunks(), pa.array(count), pa.array(n_base), pa.array(first, mask=no_place), pa.array(last, mask=no_place)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([sorted(set(x)) for x in labels], pa.list_(pa.string())), pa.array(held, pa.list_(pa.list_(pa.int32())))], _NAMES)

    def run(batches):
        release()
        for t in blocks(batches, [doc_id, text], text):
            yield rows(t)

    return run


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"]


def _need(n: int, threshold: float) -> int:
    """The least number of shared tokens that makes the threshold's share of n."""
    k = max(1, int(np.floor(threshold * n)))
    return k if k / n >= threshold else k + 1


def linked(held: DataFrame, lexicon: _Lexicon, labels: Sequence[str], threshold: float) -> DataFrame:
    """(row, block, template, label, share) of all pairs at the threshold. held: (row, block, tokens), the distinct tokens of blocks."""
    spark = held.sparkSession
    counted = held.select(F.explode("tokens").alias("t")).groupBy("t").count()
    frequency = {r.t: r["count"] for r in counted.collect()}  # at most as many rows as templates have tokens
    order = sorted(range(len(lexicon.tokens)), key=lambda t: (frequency.get(t, 0), t))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sets = [sorted(int(rank[t]) for t in ts) for ts in lexicon.templates]
    needs = [_need(len(s), threshold) for s in sets]
    whole = spark.createDataFrame([(k, labels[k], s, needs[k]) for k, s in enumerate(sets)], "template int, label string, of array<int>, need int")
    index = whole.select("template", F.size("of").alias("n"), "need", F.posexplode(F.slice(F.col("of"), F.lit(1), F.size("of") - F.col("need") + 1)).alias("i", "t"))
    in_order = F.array_sort(F.transform("tokens", lambda t: F.element_at(F.lit([int(x) for x in rank]), t + 1)))
    least = min(needs, default=1)
    rows = held.select("row", "block", in_order.alias("tokens")).where(F.size("tokens") >= least)
    spread = rows.select("row", "block", F.size("tokens").alias("m"), F.posexplode("tokens").alias("j", "t"))
    met = spread.join(small_side(index), "t").where("m >= need")
    # The first token that both share: as many can follow as stand behind it in the shorter rest.
    first = met.groupBy("row", "block", "template").agg(F.min(F.struct("i", "j", "n", "m", "need")).alias("x"))
    may = first.where(F.least(F.col("x.n") - F.col("x.i"), F.col("x.m") - F.col("x.j")) >= F.col("x.need")).select("row", "block", "template")
    both = may.join(rows, ["row", "block"]).join(small_side(whole), "template").withColumn("shared", F.size(F.array_intersect("tokens", "of")))
    return both.where("shared >= need").select("row", "block", "template", "label", (F.col("shared") / F.size("of")).alias("share"))


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_links): a row for each document. templates, phrases: few
    (text, label) rules, given by value; n_links counts links of its blocks with templates."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold: above 0, at most 1")
    lexicon = _Lexicon(templates, phrases, words)
    kind = docs.schema[doc_id].dataType.simpleString()
    with Scratch(docs.sparkSession, "licenses") as scratch:
        schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>"
        rows = docs.select(doc_id, text).mapInArrow(_scanned(lexicon, doc_id, text), schema)
        rows = scratch.staged(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")  # written once, so the numbers stay
        held = rows.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "tokens"))
        links = linked(held, lexicon, [x for x, _ in templates], threshold)
        found = links.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count("*").alias("n_links"))
        out = rows.drop("blocks").join(found, "row", "left")
        joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
        score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
        every = F.concat("base", F.coalesce("more", F.array().cast("array<string>")))
        return checkpointed(
            out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        )
