import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from vellum.llm import pieces

from .helpers import edge_docs, empty_docs


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_encodes_and_decodes_as_the_library(library):
    rng, model = random.Random(3), pieces.PieceModel(pieces.default_model())
    kinds = ["abetho ▁  the in the\n\té\U0001f600ขเ门Ａ\x00</s>1234aaaaabc", "abc the", ["the", "a", "in", "ing", "t", "h", "e", "▁", "\n", "  "]]
    texts = ["".join(rng.choice(kind) for _ in range(rng.randint(0, 40))) for kind in kinds for _ in range(3000)]
    texts += [c * n for c in ("a", "ab", "abc", "the", "=", " ", "▁", "\U0001f600") for n in (1, 2, 7, 64, 1001)] + ["the" * 20_000]
    ids = model.encode(texts)
    want = library.encode(texts)
    assert [i.tolist() for i in ids] == want
    assert model.decode(np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids])) == library.decode(want)


def test_decodes_any_ids_as_the_library(library):
    """Bytes that are no UTF-8, control pieces inside characters, leading spaces."""
    rng, model = random.Random(4), pieces.PieceModel(pieces.default_model())
    pick = lambda: rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), 28705, 259, rng.randrange(32000)])
    rows = [[pick() for _ in range(rng.randint(0, 12))] for _ in range(8000)]
    assert model.decode(np.array(sum(rows, []), np.int64), np.array(list(map(len, rows)))) == library.decode(rows)
    with pytest.raises(ValueError):
        model.decode(np.array([32000]), np.array([1]))


def test_query_on_awkward_rows(spark, library):
    docs = edge_docs(spark)
    got = sorted(map(tuple, pieces.digests(pieces.decode(pieces.encode(docs))).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=repr)
    assert pieces.digests(pieces.decode(pieces.encode(empty_docs(spark)))).count() == 0


def test_null_ids_are_an_empty_text(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [264, 259, 264])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in pieces.decode(rows).collect()} == {1: "", 2: "", 3: "a   a"}
