"""License notices in texts: exact phrases, and an exact containment join with templates.

Templates of up to 32 words are looked for in blocks of 64 words that start at
multiples of 32; both numbers double until the step is no less than a longer template's
words, so that every passage of a template's length lies in one of its blocks.  A block
matches a template that has ``threshold`` of its distinct words in it.  Words are put in order
of their global frequency, rarest first; then a match shares a word within the first
t - need + 1 of the template and the first b - need + 1 of the block (prefix filter),
has at least ``need`` words (length filter) and leaves enough words behind the first
common one on both sides (positional filter).  Words that no template has cannot be
common ones, so blocks keep only the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut
from corpusward.llm import words as W

#: Phrases whose words must follow each other, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (name, label, notice).
TEMPLATES = [
    ("gpl short", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl notice", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache short", "apache", "Licensed under the Apache License, Version 2.0."),
    ("apache notice", "apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("mit short", "mit", "Released under the MIT License."),
    ("mit grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by notice", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc short", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("bsd conditions", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]

#: A block is two steps; templates of more words than STEP have steps of 2, 4, 8, ... times as many.
STEP = 32


def _tokens(text: str) -> np.ndarray:
    return W.split([W.lower(text.encode())], W.PUNCTUATION).hashes()


class _Plan:
    """What the tasks need of templates and phrases: word hashes, numbered."""

    def __init__(self, templates, phrases: dict[str, str], threshold: float):
        words = [_tokens(t) for _, _, t in templates]
        sets = [np.unique(w) for w in words]
        self.vocabulary = np.unique(np.concatenate([*sets, np.empty(0, W.U)]))
        self.templates = [np.searchsorted(self.vocabulary, s) for s in sets]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.steps = [STEP << max(0, (len(w) - 1).bit_length() - STEP.bit_length() + 1) for w in words]
        self.phrases = [(_tokens(p), label) for p, label in phrases.items()]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of vocabulary words, and their numbers."""
        if not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        found = np.flatnonzero(self.vocabulary[at] == h)
        return found, at[found]

    def in_blocks(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each step, (step, text, block, word): each distinct word of its templates in each block, sorted."""
        at, word = self.hits(h)
        text = np.searchsorted(bounds, at, "right") - 1
        for step in sorted(set(self.steps)):
            own = np.zeros(len(self.vocabulary), bool)
            own[np.concatenate([t for t, s in zip(self.templates, self.steps, strict=True) if s == step])] = True
            i = np.flatnonzero(own[word])
            block = (at[i] - bounds[text[i]]) // step
            # A word lies in the block that starts at its step and in the one before.
            rows = np.stack([np.r_[text[i], text[i]], np.r_[block, block - 1], np.r_[word[i], word[i]]])
            rows = rows[:, rows[1] >= 0]
            rows = rows[:, np.lexsort(rows[::-1])]
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
            yield step, *rows[:, new]


def word_frequencies(rows: DataFrame, plan: _Plan) -> dict[int, int]:
    """In how many blocks each vocabulary word is; at most one number a word goes to the driver."""

    def task(batches):
        total = np.zeros(len(plan.vocabulary), np.int64)
        for batch in batches:
            for _, block in W.blocks(batch.column(0).to_pylist()):
                found = W.split([W.lower(b) for b in block], W.PUNCTUATION)
                for *_, word in plan.in_blocks(found.hashes(), found.bounds):
                    total += np.bincount(word, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    return {r["word"]: r["n"] for r in rows.select("text").mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _scan(rows: DataFrame, plan: _Plan, rank: np.ndarray) -> DataFrame:
    """Counts and phrases of each text, and the blocks with a word of some template's prefix.

    A block's words are ranks in the global order, ascending.
    """
    prefix = {step: np.zeros(len(plan.vocabulary), bool) for step in plan.steps}
    least: dict[int, int] = {}
    for t, need, step in zip(plan.templates, plan.need, plan.steps, strict=True):
        prefix[step][np.sort(rank[t])[: len(t) - need + 1]] = True
        least[step] = min(need, least.get(step, need))

    def task(batches):
        for batch in batches:
            names = batch.column(0)
            for first, block in W.blocks(batch.column(1).to_pylist()):
                found = W.split([W.lower(b) for b in block], W.PUNCTUATION)
                h, bounds, n = found.hashes(), found.bounds, len(block)
                count, low, high, labels = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1), [[] for _ in range(n)]
                for phrase, label in plan.phrases:
                    if len(h) < len(phrase):
                        continue
                    at = np.flatnonzero(np.logical_and.reduce([h[i : len(h) - len(phrase) + 1 + i] == w for i, w in enumerate(phrase)]))
                    text = np.searchsorted(bounds, at, "right") - 1
                    at, text = at[at + len(phrase) <= bounds[text + 1]], text[at + len(phrase) <= bounds[text + 1]]
                    for t in np.unique(text):
                        start = at[text == t] - bounds[t]
                        count[t] += len(start)
                        low[t] = start[0] if low[t] < 0 else min(low[t], start[0])
                        high[t] = max(high[t], start[-1])
                        labels[t].append(label)
                blocks = [[] for _ in range(n)]
                for step, text, number, word in plan.in_blocks(h, bounds):
                    order = np.lexsort((rank[word], number, text))
                    text, number, word = text[order], number[order], rank[word[order]]
                    edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (number[1:] != number[:-1])]) if len(text) else np.empty(0, np.int64)
                    size = np.diff(np.r_[edge, len(text)])
                    some = np.add.reduceat(prefix[step][word].astype(np.int64), edge) > 0 if len(edge) else np.empty(0, bool)
                    for i in np.flatnonzero(some & (size >= least[step])):
                        blocks[text[edge[i]]].append({"step": step, "block": number[edge[i]], "words": word[edge[i] : edge[i] + size[i]].tolist()})
                kind = pa.list_(pa.struct([("step", pa.int64()), ("block", pa.int64()), ("words", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, n), pa.array(_digests(h, bounds)), pa.array(np.diff(bounds)), pa.array(count), pa.array(low), pa.array(high), pa.array(labels, pa.list_(pa.string())), pa.array(blocks, kind)],
                    ["doc_id", "digest", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )

    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<step:bigint,block:bigint,words:array<int>>>")


def _digests(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits for each text's words: keeps rows apart that share an id."""
    return W.mix(W.sequences(h, bounds, 1) + np.diff(bounds).astype(W.U)).view(np.int64)


def template_matches(scanned: DataFrame, plan: _Plan, rank: np.ndarray, templates) -> DataFrame:
    """doc_id, digest, block, name, label and containment of every block that meets a template; templates may share a name."""
    spark = scanned.sparkSession
    rows = []
    for number, ((name, label, _), words, need, step) in enumerate(zip(templates, plan.templates, plan.need, plan.steps, strict=True)):
        ordered = np.sort(rank[words]).tolist()
        rows += [(step, w, i, len(ordered), need, number, name, label, ordered) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    prefixes = spark.createDataFrame(rows, "step long, word int, i int, t int, need int, number int, name string, label string, template array<int>")
    blocks = scanned.select("doc_id", "digest", F.explode("blocks").alias("b")).select("doc_id", "digest", F.col("b.step").alias("step"), F.col("b.block").alias("block"), F.col("b.words").alias("words"), F.size("b.words").alias("size"))
    probes = blocks.select("*", F.posexplode("words").alias("j", "word"))
    # The templates are the caller's own list: a row for each of their words at most.
    met = probes.join(F.broadcast(prefixes), ["step", "word"]).where((F.col("size") >= F.col("need")) & (F.col("t") - F.col("i") >= F.col("need")) & (F.col("size") - F.col("j") >= F.col("need")))
    pairs = met.groupBy("doc_id", "digest", "step", "block", "number").agg(F.any_value("name").alias("name"), F.any_value("label").alias("label"), F.any_value("words").alias("words"), F.any_value("template").alias("template"), F.any_value("need").alias("need"), F.any_value("t").alias("t"))
    both = F.size(F.array_intersect("words", "template"))
    return pairs.where(both >= F.col("need")).select("doc_id", "digest", "block", "name", "label", (both / F.col("t")).alias("containment"))


def license_report(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases; first_word and last_word are their smallest
    and largest start (null without one); labels has those of matching templates too,
    both distinct, sorted and joined by commas; score is the largest containment, 1 where
    a phrase stands.  Null texts are empty; repeated rows each get their row; a null id
    stays null.  Texts are read twice and never shuffled.
    """
    plan = _Plan(templates, phrases, threshold)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = word_frequencies(rows, plan)
    rank = np.empty(len(plan.vocabulary), np.int64)
    rank[sorted(range(len(rank)), key=lambda w: (n.get(w, 0), w))] = np.arange(len(rank))
    scanned = cut(_scan(rows, plan, rank))
    found = template_matches(scanned, plan, rank, templates).groupBy("doc_id", "digest").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    f = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "more", "most")
    out = scanned.drop("blocks").join(f, scanned["doc_id"].eqNullSafe(f["_id"]) & (scanned["digest"] == f["_digest"]), "left")
    base = F.array_sort(F.array_distinct("base"))
    all_ = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    place = lambda c: F.when(F.col("n_base") > 0, F.col(c)).alias(c)
    return out.select("doc_id", "n_words", "n_base", place("first_word"), place("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(all_, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))
