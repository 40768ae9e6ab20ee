import itertools
import random

from pyspark.sql import functions as F

from vellum.llm import licenses

from .helpers import edge_docs, empty_docs

PLAIN = ["the cat and the dog went to the house of the man", "in the year of the storm a ship was lost at sea", "by the river with that old tree it was for the people from this work"]


def scan(spark, texts, lines=PLAIN * 30):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return licenses.scan(df, licenses.train(lines)).collect()


def test_families(spark):
    said = {
        "Licensed under the Apache License, Version 2.0.": "apache",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY 4.0.": "cc-by",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa",
        "All rights reserved.": "reserved",
        "Copyright 2019 A. Person, all rights reserved": "reserved",
        "Released into the public domain": "cc0",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "Distributed under the Boost Software License, Version 1.0.": "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
        "made available under the terms of the Eclipse Public License 2.0": "epl",
        "Licensed under the Mozilla Public License 2.0": "mpl",
        "Licensed under the European Union Public Licence (EUPL)": "eupl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "SPDX-License-Identifier: Zlib": "zlib",
        "Licensed under the Artistic License 2.0": "artistic",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "ofl",
        "Made available under the Open Database License": "odbl",
    }
    rows = scan(spark, ["\n".join([PLAIN[0], s, PLAIN[1]]) for s in said])
    confirmed = {r["doc_id"]: (r["line"], r["family"]) for r in rows if r["confirmed"]}
    assert confirmed == {i: (1, f) for i, f in enumerate(said.values())}


def test_several_families_wrapped_and_long_paragraphs(spark):
    plain = " ".join(PLAIN * 20)
    rows = scan(spark, [
        "Licensed under the MIT License or the Apache License, Version 2.0.",
        "This program is free software: you can redistribute\nit and/or modify it under the terms of\nthe GNU General Public License as published",
        f"{plain} Licensed under the MIT License. {plain} All rights reserved. {plain}",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: CC-BY-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under the GNU Lesser General Public License, version 2.1", f"{plain}\n \n{plain}\n\nreleased under\nthe MIT licence",
    ])
    got = {}
    for r in rows:
        if r["confirmed"]:
            got.setdefault(r["doc_id"], set()).add((r["line"], r["family"]))
    assert got == {0: {(0, "mit"), (0, "apache")}, 1: {(0, "gpl")}, 2: {(0, "mit"), (0, "reserved")}, 3: {(0, "gpl")}, 4: {(0, "bsd")}, 5: {(0, "cc-by")}, 6: {(0, "cc-by-sa")}, 7: {(0, "lgpl")}, 8: {(4, "mit")}}


def test_matches_against_brute_force():
    """Every order-preserving choice of a template's bigrams in a short text."""
    rng = random.Random(3)
    for _ in range(200):
        family = rng.choice(["mit", "reserved", "cc0"])
        template = licenses.words_of(rng.choice(licenses.TEMPLATES[family]))[:7]
        words = [w for w in template if rng.random() < 0.8] + rng.choices(PLAIN[0].split(), k=rng.randint(0, 3))
        have = licenses.bigrams(words)
        best = max((sum(1 for _ in c) / len(g) for g in licenses._TEMPLATE_GRAMS[family] for n in range(1, len(g) + 1) for c in itertools.combinations(g[:10], n) if _in_order(c, have)), default=0.0)
        assert licenses.matches(family, words, 0.6)[1] <= best + 1e-9
        if best >= 0.8:
            assert licenses.matches(family, words, 0.6)[0]


def _in_order(grams, have):
    at = iter(have)
    return all(g in at for g in grams)


def test_held_out_statements_and_passages(spark):
    """Accuracy on statements and passages that the fit never saw."""
    rng = random.Random(5)
    unseen = {"Distributed under the MIT Licence": "mit", "The code is licensed under the Apache License": "apache", "It is licensed under GNU GPL version 2": "gpl", "Text licensed under CC BY-SA": "cc-by-sa", "(c) 2020, all rights reserved worldwide": "reserved"}
    texts = [" ".join(rng.choices(" ".join(PLAIN).split(), k=30)) + " " + s + " " + " ".join(rng.choices(" ".join(PLAIN).split(), k=30)) for s in unseen]
    said = {r["doc_id"]: r["family"] for r in scan(spark, texts) if r["probability"] >= 0.5}
    assert sum(said.get(i) == f for i, f in enumerate(unseen.values())) >= 4
    plain = [" ".join(rng.choices(" ".join(PLAIN).split(), k=60)) for _ in range(300)]
    assert len(scan(spark, plain)) <= 3


def test_what_the_sample_sends_is_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text of row "), F.col("id").cast("string")).alias("text"))
    copies = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    got = licenses.sample_passages(docs.union(copies), 100, 12)
    assert 50 <= len(got) <= 100 and all(len(g) <= 12 for g in got) and got == licenses.sample_passages(docs.union(copies), 100, 12)
    assert len(licenses.sample_passages(docs.limit(7), 100, 600)) == 7


def test_plain_text_and_near_misses_state_nothing(spark):
    assert [r for r in scan(spark, PLAIN + list(licenses.NEAR_MISSES)) if r["confirmed"]] == []


def test_edges(spark):
    model = licenses.train(PLAIN * 30)
    assert licenses.scan(edge_docs(spark), model).filter("confirmed").count() == 0
    assert licenses.license_scan(empty_docs(spark)).count() == 0
    rows = scan(spark, [None, "", "All rights reserved.\nAll rights reserved."])
    assert [(r["doc_id"], r["line"]) for r in rows] == [(2, 0), (2, 1)]
    assert licenses.train([]).threshold == 0.5
    long = "word " * 300_000 + "\nAll rights reserved."
    assert [r["line"] for r in scan(spark, [long])] == [1]


def test_statements_at_every_place_of_a_window(spark):
    """A statement that a window's edge cuts is read whole in the next window, and as no other family."""
    words = " ".join(PLAIN * 6).split()
    said = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the GNU Lesser General Public License.": "lgpl", "Licensed under CC BY 4.0.": "cc-by"}
    texts = [(" ".join(words[:n] + [s] + words[n : n + 70]), f) for s, f in said.items() for n in range(0, 100, 3)]
    rows = scan(spark, [t for t, _ in texts])
    got = {}
    for r in rows:
        if r["confirmed"]:
            got.setdefault(r["doc_id"], []).append(r["family"])
    assert got == {i: [f] for i, (_, f) in enumerate(texts)}
