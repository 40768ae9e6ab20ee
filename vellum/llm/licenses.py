"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

``train`` fits one logistic regression a family on sparse word uni- and bigrams: of the licence templates below, whole, cut, joined with each other and with
words of the corpus, against a bounded sample of the corpus (``sample_rows`` passages of at most ``sample_chars`` characters, one a row, those whose digest is
least) and near misses, sentences in the same words that grant nothing. Half of the sample is kept from the fit: a family counts only from the
probability on, at least 0.5, that no more than one in a thousand of those other passages reaches. What no family reaches is unknown.

``scan`` parts every whole text at blank lines into paragraphs, however long and however wrapped, and reads each in overlapping windows of ``window`` words, so that a statement of up to
half a window lies whole in one. Every family over the threshold counts, so one window may state several. A prediction is confirmed
where at least ``confirm`` of a template's bigrams stand in the window in their order, close together, and no other predicted family's template covers the same words and more, or the
same ones as a larger part of it (GPL inside LGPL, CC BY inside CC BY-SA). Words are compared without articles, versions and hyphens: GPL-3.0-or-later is gpl or later.

Defined results: null and empty texts have no licence rows; repeated rows give repeated rows; a text may have several
rows, one a family and place; a prediction that no template confirms has the line where its window begins; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches

#: How documents commonly state a licence, by family.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2.0", "spdx-license-identifier: apache-2.0", "released under the apache license", "licensed under apache-2.0", "license: apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses",
    ),
    "mit": (
        "licensed under the mit license", "spdx-license-identifier: mit", "released under the mit license", "licensed under mit", "license: mit", "distributed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
    ),
    "bsd": (
        "licensed under the bsd license", "spdx-license-identifier: bsd-3-clause", "released under the bsd license", "licensed under bsd-2-clause", "license: bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "gpl": (
        "licensed under the gnu general public license", "released under the gnu general public license", "spdx-license-identifier: gpl-3.0", "licensed under the gpl", "licensed under gpl-3.0-or-later", "license: gpl-3.0",
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license", "spdx-license-identifier: lgpl-3.0", "licensed under the lgpl", "license: lgpl-3.0",
        "redistribute it and/or modify it under the terms of the gnu lesser general public license",
    ),
    "agpl": ("licensed under the gnu affero general public license", "spdx-license-identifier: agpl-3.0", "licensed under the agpl", "redistribute it and/or modify it under the terms of the gnu affero general public license"),
    "mpl": ("licensed under the mozilla public license", "spdx-license-identifier: mpl-2.0", "subject to the terms of the mozilla public license v 2.0", "licensed under mpl-2.0"),
    "cc0": ("cc0 1.0 universal public domain dedication", "dedicated to the public domain", "released into the public domain", "spdx-license-identifier: cc0-1.0", "licensed under cc0"),
    "cc-by": ("licensed under cc by 4.0", "spdx-license-identifier: cc-by-4.0", "licensed under a creative commons attribution 4.0 international license", "available under the creative commons attribution license"),
    "cc-by-sa": ("licensed under cc by-sa 4.0", "spdx-license-identifier: cc-by-sa-4.0", "licensed under a creative commons attribution-sharealike 4.0 international license", "available under the creative commons attribution share alike license"),
    "cc-by-nc": ("licensed under cc by-nc 4.0", "spdx-license-identifier: cc-by-nc-4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license", "available under the creative commons attribution non commercial license"),
    "cc-by-nd": ("licensed under cc by-nd 4.0", "spdx-license-identifier: cc-by-nd-4.0", "licensed under a creative commons attribution-noderivatives 4.0 international license", "available under the creative commons attribution no derivatives license"),
    "isc": (
        "licensed under the isc license", "spdx-license-identifier: isc", "released under the isc license", "license: isc",
        "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "boost": (
        "licensed under the boost software license", "spdx-license-identifier: bsl-1.0", "distributed under the boost software license",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    "epl": (
        "licensed under the eclipse public license", "spdx-license-identifier: epl-2.0", "licensed under epl-2.0", "made available under the terms of the eclipse public license",
        "the accompanying program is provided under the terms of this eclipse public license",
    ),
    "eupl": ("licensed under the european union public license", "spdx-license-identifier: eupl-1.2", "licensed under the eupl"),
    "unlicense": ("licensed under the unlicense", "released under the unlicense", "spdx-license-identifier: unlicense", "this is free and unencumbered software released into the public domain"),
    "zlib": (
        "licensed under the zlib license", "spdx-license-identifier: zlib", "license: zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
    "artistic": ("licensed under the artistic license", "spdx-license-identifier: artistic-2.0", "under the terms of the artistic license"),
    "ofl": ("licensed under the sil open font license", "spdx-license-identifier: ofl-1.1", "this font software is licensed under the sil open font license"),
    "odbl": ("licensed under the open database license", "spdx-license-identifier: odbl-1.0", "made available under the open database license", "licensed under the odbl"),
    "wtfpl": ("licensed under the wtfpl", "spdx-license-identifier: wtfpl", "do what the fuck you want to public license"),
    "reserved": ("all rights reserved", "copyright all rights reserved", "no part of this publication may be reproduced without written permission"),
}
#: Sentences in a licence's words that grant or reserve nothing.
NEAR_MISSES = (
    "the driver had a license and a copy of the work", "he is licensed to drive under the age of 21", "all people reserved a seat", "the general public may use the source",
    "the software is in version 2.0", "the public library is free", "a person obtaining a copy of the book", "with or without the permission of the driver",
    "the commons is a creative place", "the apache people", "this work is under way", "international public rights", "a mit of the general",
    "the rights of all people", "a table reserved by the general", "license and registration please", "the domain is public", "released under water", "distributed under the table",
    "the open database of the font", "a boost for the software", "permission to use the copy of the database", "an eclipse seen by the public", "an artistic work for any purpose", "the terms of the european union", "do what you want", "with or without a fee", "made available to the public", "the free software of this program",
)
_WORDS = re.compile(r"[^\W\d_]+[0-9]*")
#: Words that a statement may have or lack, and spellings of one word.
_DROPPED = frozenset(("the", "a", "an", "this", "v"))
_SAME = {"licence": "license", "licenced": "licensed", "licences": "licenses", "gplv2": "gpl", "gplv3": "gpl", "gpl2": "gpl", "gpl3": "gpl", "lgplv3": "lgpl", "lgplv2": "lgpl", "agplv3": "agpl", "ccby": "cc by", "share": "sharealike", "alike": "", "non": "", "commercial": "noncommercial", "no": "", "derivatives": "noderivatives"}
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def placed_words(text: str) -> tuple[list[str], list[int]]:
    """A text's words as they are compared, and where each begins."""
    words, at = [], []
    for m in _WORDS.finditer(text):
        word = m[0].lower()
        for w in _SAME.get(word, word).split():
            if w not in _DROPPED:
                words.append(w)
                at.append(m.start())
    return words, at


def words_of(text: str) -> list[str]:
    return placed_words(text)[0]


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def ngrams(words: list[str]) -> list[str]:
    return words + bigrams(words)


_TEMPLATE_GRAMS = {family: [bigrams(words_of(t)) for t in ts] for family, ts in TEMPLATES.items()}


def matches(family: str, words: list[str], confirm: float) -> tuple[list[tuple[int, frozenset, float]], float]:
    """Where templates of the family stand (first word, all matched words, share of the template), and the largest share of a template's bigrams that stand in order and close together."""
    have = bigrams(words)
    found, most = {}, 0.0
    for grams in _TEMPLATE_GRAMS[family]:
        if not set(have) & set(grams):
            continue
        start = 0
        while start < len(have):
            if have[start] not in grams:
                start += 1
                continue
            hits, at = [], start
            for g in grams:
                near = have[at : start + 2 * len(grams)]
                if g in near:
                    at += near.index(g)
                    hits.append(at)
                    at += 1
            share = len(hits) / len(grams)
            most = max(most, share)
            if share >= confirm:
                covers = frozenset(i for h in hits for i in (h, h + 1))
                if (len(covers), share) > (len(found[hits[0]][0]), found[hits[0]][1]) if hits[0] in found else True:
                    found[hits[0]] = covers, share
                start = max(hits)
            start += 1
    # of overlapping places of a family the widest
    out = []
    for at, (covers, share) in sorted(found.items(), key=lambda f: (-len(f[1][0]), f[0])):
        if not any(covers & other for _, other, _ in out):
            out.append((at, covers, share))
    return out, most


@dataclass
class LicenseModel:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # (features + 1, families); the last row is the bias
    threshold: float

    def features(self, words: list[str]) -> list[int]:
        return sorted({self.vocabulary[g] for g in ngrams(words) if g in self.vocabulary})

    def probabilities(self, features: list[list[int]]) -> np.ndarray:
        z = np.stack([self.weights[f].sum(axis=0) if f else np.zeros(self.weights.shape[1]) for f in features]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def sample_passages(docs: DataFrame, sample_rows: int, sample_chars: int) -> list[str]:
    """A passage of each of about ``sample_rows`` different rows, those with the least digests; a bounded sample that the fit alone uses. All tasks
    together send about as many: the digests' cut follows from the number of rows."""
    texts = docs.filter("text IS NOT NULL").select(F.xxhash64("doc_id", "text", F.lit("license")).alias("h"), "text")
    n = texts.count()
    cut = int(-(2**63) + 2**64 * min(1.0, 1.5 * sample_rows / max(n, 1))) - 1
    start = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - sample_chars, F.lit(0)) + 1) + 1
    rows = texts.filter(F.col("h") <= cut).select("h", F.substr("text", start.cast("int"), F.lit(sample_chars)).alias("passage"))
    return [r["passage"] for r in rows.distinct().orderBy("h").limit(sample_rows).collect()]


def train(passages: list[str], window: int = 48, confirm: float = 0.6, rounds: int = 400, rate: float = 2.0, decay: float = 1e-4, seed: int = 3, common_share: float = 0.01) -> LicenseModel:
    """Full-batch gradient descent on the templates' variants and the unknown passages."""
    families = sorted(TEMPLATES)
    bare = [w[at : at + window] for w in map(words_of, passages) for at in range(0, max(1, len(w)), window)]
    bare = [w for w in bare if not any(matches(f, w, confirm)[0] for f in families)]
    # words that stand in many windows tell nothing; without them a window of no vocabulary word has no feature at all
    often = Counter(w for words in bare for w in set(words))
    common = {w for w, n in often.items() if n > common_share * len(bare)}
    grams = sorted({g for ts in TEMPLATES.values() for t in ts for g in ngrams(words_of(t)) if not common.issuperset(g.split())})
    vocabulary = {g: i for i, g in enumerate(grams)}
    model = LicenseModel(families, vocabulary, np.zeros((len(grams) + 1, len(families))), 0.5)
    rng = np.random.Generator(np.random.PCG64(seed))
    fit, other = bare[::2], bare[1::2]
    filler = [w for words in fit for w in words] or ["word"]
    said = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]
    templates = [(label, words_of(t)) for label, family in enumerate(families) for t in TEMPLATES[family]]
    rows: list[tuple[list[str], tuple[int, ...]]] = []
    for label, words in templates:
        for extra in (0, 0, 2, 6, 12):
            rows.append((said(extra) + words + said(extra), (label,)))
        if len(words) > 6:
            cut = int(0.7 * len(words))
            rows += [(words[:cut], (label,)), (words[-cut:], (label,))]
        for i in rng.integers(0, len(templates), 3):  # two licences in one window
            rows.append((words + [("or", "and")[i % 2]] + templates[i][1], (label, templates[i][0])))
    near = [words_of(t) for t in NEAR_MISSES]
    rows += [(words, ()) for words in [*fit, *near * 4, *(said(6) + w + said(6) for w in near * 2)]]
    x, y = np.zeros((len(rows), len(grams) + 1)), np.zeros((len(rows), len(families)))
    for i, (words, labels) in enumerate(rows):
        x[i, model.features(words)] = 1
        y[i, list(labels)] = 1
    x[:, -1] = 1
    # the rows of a family weigh as much as a tenth of the others together
    weight = np.where(y > 0, np.maximum(1, 0.1 * (len(rows) - y.sum(axis=0)) / np.maximum(y.sum(axis=0), 1)), 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -60, 60)))
        model.weights -= rate * (x.T @ ((p - y) * weight) / weight.sum(axis=0) * 4 + decay * model.weights)
    if other:
        model.threshold = max(0.5, float(np.quantile(model.probabilities([model.features(w) for w in other]).max(axis=1), 0.999)))
    return model


def scan(docs: DataFrame, model: LicenseModel, confirm: float = 0.6, window: int = 48) -> DataFrame:
    """doc_id, line, family, probability, coverage and confirmed for each statement of a licence (line: that of its first word, from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the templates
    schema = "doc_id long, line int, family string, probability double, coverage double, confirmed boolean"

    def make():
        m = shared.value
        cues = frozenset(w for g in m.vocabulary for w in g.split() if w in m.vocabulary)
        half = window // 2

        def statements(words):
            """(word or -1 - window's first word, family): (probability, coverage, confirmed)."""
            out: dict[tuple[int, int], tuple[float, float, bool]] = {}
            for first in sorted({max(0, (i // half + back) * half) for i, w in enumerate(words) if w in cues for back in (-1, 0)}):
                here = words[first : first + window]
                p = m.probabilities([m.features(here)])[0]
                said = {f: matches(m.families[f], here, confirm) for f in np.flatnonzero(p >= m.threshold).tolist()}
                for f, (places, most) in said.items():
                    sure = [at for at, covers, share in places if not any(covers < c or covers == c and share < s for g, (others, _) in said.items() if g != f for _, c, s in others)]
                    if places and not sure:
                        continue  # another family's words
                    # what the window's edge may have cut lies whole in a neighbour
                    cut = [c for _, c, _ in places if first and min(c) == 0 or first + window < len(words) and max(c) == window - 1]
                    if cut and len(cut) == len(places):
                        continue
                    sure = [at for at in sure if not any(at == min(c) for c in cut)]
                    for place in [first + at for at in sure] or [-1 - first]:
                        key, value = (place, f), (float(p[f]), most, bool(sure))
                        out[key] = max(out.get(key, value), value)
            # what a neighbour window confirms needs no unconfirmed row besides
            near = {(f, at // half + d) for (at, f), v in out.items() if v[2] for d in (-2, -1, 0, 1)}
            return {k: v for k, v in out.items() if v[2] or (k[1], (-1 - k[0]) // half) not in near}

        def step(cols):
            out = {c: [] for c in ("doc_id", "line", "family", "probability", "coverage", "confirmed")}
            for doc_id, text in zip(cols["doc_id"], cols["text"]):
                start = 0
                for end in [*(p.span() for p in _PARAGRAPH.finditer(text or "")), (len(text or ""), 0)]:
                    words, at = placed_words((text or "")[start : end[0]])
                    if not cues.isdisjoint(words):
                        for (place, f), (p, share, sure) in sorted(statements(words).items(), key=lambda x: (x[0][0] if x[0][0] >= 0 else -1 - x[0][0], x[0][1])):
                            line = text.count("\n", 0, start + at[place if place >= 0 else -1 - place])
                            for c, v in zip(out, (doc_id, line, m.families[f], p, share, sure)):
                                out[c].append(v)
                    start = end[1]
            return out

        return step

    return map_batches(docs.select("doc_id", "text"), make, schema)


def license_scan(docs: DataFrame, sample_rows: int = 2000, sample_chars: int = 600) -> DataFrame:
    return scan(docs, train(sample_passages(docs, sample_rows, sample_chars)))
