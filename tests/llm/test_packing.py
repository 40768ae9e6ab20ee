import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import packing
from vellum.llm.tokens import WordTokenizer, default_tokenizer

from .helpers import edge_docs, empty_docs

TEXTS = ["", "It's I'LL don't!'s 12a3 b\x1cq\x85z", "éa ́b ß ﬁ ª µ × ÷ 漢字 \U0001f600x", "foo<|endoftext|>bar  a\nb\tc", "İstanbul Σίσυφος", "STRASSE straße ÀÖØÞ"]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def whole_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_word_table_gives_the_ids_of_whole_texts():
    tok = WordTokenizer(default_tokenizer())
    for text in TEXTS:
        assert np.frombuffer(tok.ids(text), "<u4").tolist() == whole_ids(text), text
    assert tok.ids(None) == b""


def test_texts_are_encoded_together_and_a_piece_once():
    tok = WordTokenizer(default_tokenizer())
    texts = [*TEXTS, None, " \ta\x0bWord word, \x0c word.\r\n", "word's WORD!! word,. ,word \x85word x\u3000y word;", "a" * 5000]
    assert [np.frombuffer(b.as_py(), "<u4").tolist() for b in tok.ids_of(pa.array(texts))] == [whole_ids(t) for t in texts]
    tok, made = WordTokenizer(default_tokenizer()), []
    piece = tok.pieces.make
    tok.pieces.make = lambda p: made.append(p) or piece(p)
    tok.ids_of(pa.array(["Word word, WORD. word", "word; Word"]))
    assert tok.ids("word, Word") == tok.ids_of(pa.array(["word, Word"]))[0].as_py()
    assert sorted(made) == [",", ".", ";", "word"]


def check(rows, docs, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for doc_id, text in docs.items():
        ids = np.array([*whole_ids(text), 0], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), capacity))
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in pieces) == len(ids)
    return len(by_seq)


def test_edge_table(spark):
    df = edge_docs(spark)
    rows = packing.best_fit_packing(df).collect()
    twice = [r for r in rows if r["doc_id"] == 10]
    assert len(twice) == 2
    rows = [r for r in rows if r["doc_id"] != 10]
    check([r for r in packing.best_fit_packing(df.filter("doc_id <> 10 OR doc_id IS NULL")).collect()], {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] != 10}, 2048)
    assert packing.best_fit_packing(empty_docs(spark)).count() == 0


def test_levels_lose_nothing_and_stay_near_the_bound(spark):
    rng = np.random.default_rng(5)
    docs = {i: "word " * int(n) for i, n in enumerate(rng.integers(0, 40, 600))}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    pieces = packing.tokenize_pieces(df, capacity=32)
    rows = packing.pack(pieces, 32, items_per_task=40, fan_in=3).collect()
    n = check(rows, docs, 32)
    total = sum(r["length"] for r in rows)
    assert n <= 1.08 * -(-total // 32)
    one = packing.pack(pieces, 32).collect()
    assert check(one, docs, 32) <= 1.03 * -(-total // 32)


def test_best_fit_is_best_fit():
    assert packing.best_fit([6, 5, 5, 4], 10) == [[0, 3], [1, 2]]
    assert packing.best_fit([], 10) == []


def test_too_many_underfull_sequences_for_fewer_partitions(spark):
    """Most documents are over half a sequence, so no level gets by with fewer partitions; the small ones still meet."""
    docs = {i: "word " * (20 if i % 10 else 2) for i in range(400)}
    pieces = packing.tokenize_pieces(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), capacity=32)
    n = check(packing.pack(pieces, 32, items_per_task=40, fan_in=3).collect(), docs, 32)
    assert 360 <= n <= 360 + 10


def test_copies_of_one_row_are_dealt_out(spark):
    pieces = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(7).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    seen = packing.pack(pieces, 32, items_per_task=500)
    assert seen.count() == 3000 and seen.select("sequence_id").distinct().count() <= 756
    sizes = [len(p) for p in packing.dealt_evenly(pieces, 6, 1).rdd.glom().collect()]
    assert max(sizes) < 2 * 3000 / 6
