"""Licence statements found by a trained paragraph classifier.

A paragraph (line) is cut into overlapping windows of words.  A sparse logistic
regression on word uni- and bigrams names a licence family or the unknown class for
each window.  It is trained on half of the corpus's paragraphs: their words are
examples of the unknown class, and each is also the surroundings of a template
sentence.  Each step of the descent is one pass over the examples' features, summed
in fixed point, so the model does not depend on how rows are dealt to tasks.  The
unknown class's margin is calibrated on the other half.  A prediction is confirmed by
comparing the window with the family's template sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.llm.linear import FEATURES, distinct, features, posteriors
from risklens.llm.textvec import U64, Hasher, Texts, mix, ranges, slices
from risklens.session import materialize

# How each licence family is usually stated.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU General Public License version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)


TRAIN, HELD = 0, 1
STEPS = 1 << 14  # errors are summed as whole numbers, of so many to the smallest weight
MARGIN_STEPS = 1 << 20


@dataclass(frozen=True)
class LicenceRules:
    """Half of the paragraphs, by hash of their words, trains the classifier in at most
    ``rounds`` steps, the other half calibrates it."""

    window: int = 24
    stride: int = 12
    rounds: int = 10
    false_rate: float = 0.001  # of calibration paragraphs that may pass as a licence
    similarity_pct: int = 60  # of a template's word pairs that confirm it


def _hashes(texts: list[str]) -> list[np.ndarray]:
    hasher, slice_ = Hasher(), Texts(pa.array(texts, pa.string()), lower=True)
    starts, ends = slice_.words()
    h = hasher.span(hasher.prefix(slice_.data), starts, ends) if len(starts) else np.zeros(0, dtype=U64)
    first = slice_.split(starts)
    return [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U64(0x9FB21C651E98DF25) + h[1:] + U64(1))


class Paragraphs:
    """Words of a slice, and its paragraphs with any."""

    def __init__(self, texts: Texts, hasher: Hasher):
        self.starts, self.ends = texts.words()
        self.h = hasher.span(hasher.prefix(texts.data), self.starts, self.ends) if len(self.starts) else np.zeros(0, dtype=U64)
        self.row = np.searchsorted(texts.rows, self.starts, side="right") - 1
        breaks = np.cumsum(np.concatenate([[0], texts.data == 10]))
        self.number = breaks[self.starts] - breaks[texts.rows[self.row]]
        self.line = np.cumsum(np.diff(self.row, prepend=-1).astype(bool) | np.diff(self.number, prepend=-1).astype(bool))
        self.heads = np.flatnonzero(np.diff(self.line, prepend=-1))
        self.sizes = np.diff(np.append(self.heads, len(self.line)))

    def stating(self, raw: bytes) -> np.ndarray:
        """Which paragraphs hold a template's first words, or a licence by name, and cannot
        stand for the unknown class."""
        out = np.zeros(len(self.heads), dtype=bool)
        first = self.starts[self.heads]
        for anchor in _ANCHORS:
            at = raw.find(anchor)
            while at >= 0:
                j = int(np.searchsorted(first, at, side="right")) - 1
                end = int(self.ends[self.heads[j] + self.sizes[j] - 1])
                text = " ".join(raw[first[j] : end].decode("utf-8", "replace").split())
                out[j] = any(p in text for p in _OPENINGS)
                at = raw.find(anchor, end if out[j] else at + 1)
        return out


def _openings() -> tuple[list[str], list[bytes]]:
    found = {" ".join(t.lower().split()[:4]) for ts in TEMPLATES.values() for t in ts}
    plain = sorted(x for x in found if not re.search("licen[sc]e", x))
    return ["license", "licence", *plain], [b"license", b"licence", *sorted({max(x.split(), key=len).encode() for x in plain})]


_OPENINGS, _ANCHORS = _openings()


def _window_features(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (window, feature) of windows of the words ``h``."""
    n = np.arange(len(at))
    one, two = features(h, False), (_pairs(h) >> U64(50)).astype(np.int64)
    owner = np.concatenate([np.repeat(n, size), np.repeat(n, size - 1)])
    return distinct(owner, np.concatenate([one[ranges(at, size)], two[ranges(at, size - 1)]]))


def _hosted(p: Paragraphs, use: np.ndarray, dice: np.ndarray, rules: LicenceRules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A template stated inside each paragraph of ``use``: words, windows, sizes, families.

    ``dice`` chooses the template, its place, and for half of them words of a longer
    template that are left out."""
    words = _hashes([t for f in FAMILIES for t in TEMPLATES[f]])
    family = np.repeat(np.arange(len(FAMILIES)), [len(TEMPLATES[f]) for f in FAMILIES])
    of = ((dice >> U64(8)) % U64(len(words))).astype(np.int64)
    length = np.array([len(w) for w in words])[of]
    begin = np.cumsum([0] + [len(w) for w in words])[of] + len(p.h)
    room = np.maximum(rules.window - length, 0)
    cut = ((dice >> U64(20)) % (room + 1).astype(U64)).astype(np.int64)
    before, after = np.minimum(cut, p.sizes[use]), np.minimum(room, p.sizes[use])
    after -= before
    lengths = np.stack([before, length, after], axis=1)
    at = np.stack([p.heads[use], begin, p.heads[use] + before], axis=1)
    owner = np.repeat(np.arange(len(use)), lengths.sum(axis=1))
    stated = np.repeat(np.tile([False, True, False], len(use)), lengths.ravel())
    spot = ranges(at.ravel(), lengths.ravel())
    out = stated & (((dice >> U64(6)) & U64(1)).astype(bool) & (length > 8))[owner] & (mix(dice[owner] + (spot - begin[owner]).astype(U64)) % U64(10) == 0)
    h, owner = np.concatenate([p.h, *words])[spot[~out]], owner[~out]
    size = np.bincount(owner, minlength=len(use))
    return h, np.cumsum(size) - size, size, family[of]


def examples(docs: DataFrame, half: int, rules: LicenceRules) -> DataFrame:
    """Distinct features of the windows of all paragraphs of a half that state nothing,
    packed by slice: of those that train with the class, also with a template inside; of
    the others with the number of windows of each paragraph."""

    def packed(h: np.ndarray, at: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple:
        owner, feature = _window_features(h, at, size)
        return np.bincount(owner, minlength=len(at)).astype("<u2").tobytes(), feature.astype("<u2").tobytes(), label.astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches, "text", 1 << 20):
            texts = Texts(part.column("text"), lower=True)
            p = Paragraphs(texts, hasher)
            if not len(p.heads):
                continue
            own = mix(np.add.reduceat(mix(p.h), p.heads))
            open_ = ~p.stating(texts.data.tobytes())
            use = np.flatnonzero(open_ & (own & U64(1) == U64(half)))
            if not len(use):
                continue
            count = -(-p.sizes[use] // rules.window)
            last = np.repeat(np.maximum(p.sizes[use] - rules.window, 0), count)
            at = np.repeat(p.heads[use], count) + np.minimum(ranges(np.zeros(len(use), dtype=np.int64), count) * rules.window, last)
            size = np.minimum(np.repeat(p.sizes[use], count), rules.window)
            rows = [packed(p.h, at, size, np.full(len(at), UNKNOWN) if half == TRAIN else count)]
            if half == TRAIN:
                rows.append(packed(*_hosted(p, use, own[use], rules)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["sizes", "features", "labels"])

    return docs.select("text").mapInArrow(run, "sizes binary, features binary, labels binary")


def _read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, windows' sizes, labels) of each packed row."""
    for f, n, y in zip(b.column("features").to_pylist(), b.column("sizes").to_pylist(), b.column("labels").to_pylist()):
        yield np.frombuffer(f, "<u2").astype(np.int64), np.frombuffer(n, "<u2").astype(np.int64), np.frombuffer(y, "<u4").astype(np.int64)


def _totals(table: DataFrame, add, width: int) -> np.ndarray:
    """Sums (features and one more x ``width``) of the whole numbers that ``add`` puts into a
    task's array; a bounded number comes to the driver."""
    names = [f"g{c}" for c in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, FEATURES + 1), dtype=np.int64)
        for b in batches:
            for flat, sizes, y in _read(b):
                add(sums, flat, sizes, y)
        met = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *[pa.array(x[met]) for x in sums]], names=["feature", *names])

    rows = table.mapInArrow(run, "feature int, " + ", ".join(f"{n} bigint" for n in names)).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((width, FEATURES + 1))
    for row in rows.collect():  # one job, however many partitions
        out[:, row[0]] = row[1:]
    return out


class LicenceModel:
    """Classifier (weights and biases of each family and the unknown class), margin of the
    unknown class and templates' word pairs."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray, margin: float = 0.5):
        self.weight, self.bias, self.margin = weight, bias, margin
        self.templates = [[np.unique(_pairs(h)) for h in _hashes(TEMPLATES[f])] for f in FAMILIES]

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores (classes x windows) of windows' features, window after window."""
        if not len(sizes):
            return np.zeros((len(self.weight), 0))
        return np.stack([np.add.reduceat(w.take(flat), np.cumsum(sizes) - sizes) + b for w, b in zip(self.weight, self.bias)])

    def similarity(self, family: int, h: np.ndarray) -> int:
        """Percent of the word pairs of the family's best template that occur."""
        mine = _pairs(h)
        return max(100 * int(np.isin(t, mine).sum()) // max(len(t), 1) for t in self.templates[family])


def _plain() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The templates by themselves as examples."""
    words = _hashes([t for f in FAMILIES for t in TEMPLATES[f]])
    size = np.array([len(w) for w in words])
    owner, feature = _window_features(np.concatenate(words), np.cumsum(size) - size, size)
    return feature, np.bincount(owner), np.repeat(np.arange(len(FAMILIES)), [len(TEMPLATES[f]) for f in FAMILIES])


def _counted(sums: np.ndarray, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> None:
    """Windows of each class that hold each feature, and in the last place all."""
    both = np.repeat(y, sizes) * (FEATURES + 1) + flat
    sums += np.bincount(both, minlength=sums.size).reshape(sums.shape)
    sums[:, FEATURES] += np.bincount(y, minlength=len(sums))


def fit(train: DataFrame, rules: LicenceRules) -> LicenceModel:
    """One-against-rest logistic regression on all training windows, by accelerated
    descent.  Half of a class's weight is its own; the rest's is shared equally by the
    unknown class and the families.  Features are scaled by their log-frequency ratio."""
    n, plain = UNKNOWN + 1, _plain()
    count, alone = _totals(train, _counted, n), np.zeros((n, FEATURES + 1), dtype=np.int64)
    _counted(alone, *plain)
    # a family's templates by themselves weigh as much as those inside other text
    shares = [np.where(x[:, -1] > 0, 1.0, 0.0) for x in (count, alone)]
    shares = [x / np.maximum(shares[0] + shares[1], 1) for x in shares]
    rate_of = sum(x[:, :-1] * (s / np.maximum(x[:, -1], 1))[:, None] for x, s in zip((count, alone), shares))
    lot = np.zeros((n, n))  # of the classes of examples in each problem
    for c in range(n):
        others = [y for y in range(n) if y != c]
        for y in others:
            lot[c, y] = 0.5 / len(others) if c == UNKNOWN else 0.25 if y == UNKNOWN else 0.25 / (len(others) - 1)
        lot[c, c] = 0.5
    rest = np.array([sum(lot[c, y] * 2 * rate_of[y] for y in range(n) if y != c) for c in range(n)])
    ratio = np.log((rate_of + 1e-3) / (rest + 1e-3))
    each = [lot * (s / np.maximum(x[:, -1], 1))[None, :] for x, s in zip((count, alone), shares)]
    unit = np.array([STEPS / min(w[w > 0].min() for w in (each[0][c], each[1][c]) if w.any()) for c in range(n)])
    # the curvature is at most a quarter of the mean squared length; windows have up to 47 features
    norm = np.array([(ratio[c] ** 2 * (lot[c] @ rate_of)).sum() for c in range(n)]) + 1
    rate = 4.0 / norm
    model = LicenceModel(np.zeros((n, FEATURES)), np.zeros(n))

    def gradient(model: LicenceModel, weights: np.ndarray):
        def add(sums: np.ndarray, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> None:
            owner = np.repeat(np.arange(len(sizes)), sizes)
            score = model.scores(flat, sizes)
            for c in range(n):
                error = np.rint((1 / (1 + np.exp(-np.clip(score[c], -30, 30))) - (y == c)) * (weights[c, y] * unit[c]))
                sums[c, :FEATURES] += np.bincount(flat, weights=error.take(owner), minlength=FEATURES).astype(np.int64)
                sums[c, FEATURES] += int(error.sum())

        return add

    w, b = np.zeros((n, FEATURES)), np.zeros(n)
    step_w, step_b = np.zeros((n, FEATURES)), np.zeros(n)
    for k in range(rules.rounds):
        if k == 0:  # every score is 0: the counts say it all
            g = sum(((0.5 - np.eye(n)) * e) @ x for e, x in zip(each, (count, alone)))
        else:
            g = np.zeros((n, FEATURES + 1), dtype=np.int64)
            gradient(model, each[1])(g, *plain)
            g = (g + (_totals(train, gradient(model, each[0]), n) if count[:, -1].any() else 0)) / unit[:, None]
        step_w = 0.8 * step_w - rate[:, None] * 4 * g[:, :-1] * ratio
        step_b = 0.8 * step_b - rate * 4 * g[:, -1]
        w, b = w + step_w, b + step_b
        model = LicenceModel(w * ratio, b.copy())
    return model


def calibrated(held: DataFrame, model: LicenceModel, rules: LicenceRules) -> LicenceModel:
    """The model with the margin that ``false_rate`` of all held-out paragraphs pass; a
    paragraph counts as its most certain window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(MARGIN_STEPS + 1, dtype=np.int64)
        for b in batches:
            for flat, sizes, count in _read(b):
                stated = 1 - posteriors(model.scores(flat, sizes).T)[:, UNKNOWN]
                best = np.maximum.reduceat(stated, np.cumsum(count) - count)
                np.add.at(sums, np.ceil(np.maximum(best, 0.5) * MARGIN_STEPS).astype(np.int64), 1)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["step", "n"])

    rows = held.mapInArrow(run, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect()
    found = sorted((r.step, r.n) for r in rows)  # bounded: one number for each step
    allowed, margin = rules.false_rate * sum(n for _, n in found), 0.5
    for step, n in reversed(found):
        allowed -= n
        if allowed < 0:
            margin = step / MARGIN_STEPS
            break
    return LicenceModel(model.weight, model.bias, max(0.5, margin))


def train_model(docs: DataFrame, rules: LicenceRules = LicenceRules()) -> LicenceModel:
    """Model from the templates and all paragraphs of the corpus."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    model = fit(materialize(examples(texts, TRAIN, rules), "examples"), rules)
    return calibrated(examples(texts, HELD, rules), model, rules)


def find_licences(df: DataFrame, model: LicenceModel, rules: LicenceRules = LicenceRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that states a licence: doc_id, paragraph (line number from 0),
    first_word, family, probability, similarity (percent of the template) and confirmed.

    Every paragraph of every text is scanned whole, window by window; the most certain
    window is reported.  A window passes if its licence probability exceeds the
    calibrated margin and a family beats the others.  Null, empty and blank
    texts state nothing; repeated rows give repeated results; null ids are kept.  Only the
    two named columns are read.  An empty table gives an empty table.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    weight, bias = model.weight, model.bias

    def windows(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, first word and size of every window."""
        heads = np.flatnonzero(np.diff(line, prepend=-1))
        sizes = np.diff(np.append(heads, len(line)))
        count = np.maximum(-(-(sizes - rules.window) // rules.stride), 0) + 1
        start = np.repeat(heads, count) + ranges(np.zeros(len(heads), dtype=np.int64), count) * rules.stride
        end = np.minimum(start + rules.window, np.repeat(heads + sizes, count))
        return np.repeat(line[heads], count), start, end - start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches, "text", 1 << 20):
            texts = Texts(part.column("text"), lower=True)
            p = Paragraphs(texts, hasher)
            if not len(p.h):
                continue
            h, row, number, line, starts = p.h, p.row, p.number, p.line, p.starts
            _, at, size = windows(h, line)
            # sums of feature weights per window; repeats inside a window count once only
            # for windows that come near a licence
            one = features(h, False)
            two = (_pairs(h) >> U64(50)).astype(np.int64)
            rough = np.zeros((len(at), UNKNOWN + 1))
            for c in range(UNKNOWN + 1):
                sums = np.concatenate([[0], np.cumsum(weight[c][one])])
                both = np.concatenate([[0], np.cumsum(weight[c][two])])
                rough[:, c] = sums[at + size] - sums[at] + both[at + size - 1] - both[at] + bias[c]
            near = np.flatnonzero(rough[:, :UNKNOWN].max(axis=1) > rough[:, UNKNOWN] - 10)
            if not len(near):
                continue
            at, size = at[near], size[near]
            keys = _window_features(h, at, size)
            p = posteriors(model.scores(keys[1], np.bincount(keys[0], minlength=len(near))).T)
            stated = 1 - p[:, UNKNOWN]
            hits = np.flatnonzero(stated > model.margin)
            best: dict[tuple[int, int], tuple] = {}
            for i in hits.tolist():
                place = int(row[at[i]]), int(number[at[i]])
                family = int(p[i, :UNKNOWN].argmax())
                found = (model.similarity(family, h[at[i] : at[i] + size[i]]), float(stated[i]), -int(at[i]), family)
                best[place] = max(best.get(place, (-1,)), found)
            ids = part.column("doc_id").to_pylist()
            first = texts.split(starts)
            rows = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for (r, _), _ in rows], pa.int64()), pa.array([n for (_, n), _ in rows], pa.int64()),
                 pa.array([-f[2] - int(first[r]) for (r, _), f in rows], pa.int64()), pa.array([FAMILIES[f[3]] for _, f in rows], pa.string()),
                 pa.array([f[1] for _, f in rows], pa.float64()), pa.array([f[0] for _, f in rows], pa.int32()),
                 pa.array([f[0] >= rules.similarity_pct for _, f in rows], pa.bool_())],
                names=["doc_id", "paragraph", "first_word", "family", "probability", "similarity", "confirmed"],
            )

    return docs.mapInArrow(
        run, "doc_id bigint, paragraph bigint, first_word bigint, family string, probability double, similarity int, confirmed boolean"
    )


def licence_query(docs: DataFrame) -> DataFrame:
    """All licence statements of all documents, confirmed or not."""
    return find_licences(docs, train_model(docs))
