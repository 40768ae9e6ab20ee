import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import language

from .helpers import LONG, edge_docs, empty_docs

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no sample tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    out = language.classify(docs, language.learn(docs.filter(~language.held_out(F.col("doc_id")))))
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").filter(language.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    df = edge_docs(spark)
    model = language.Languages({"en": b"the words of a lorem ipsum dolor no id at all " * 20, "de": b"der die das und nicht mit " * 20}, 0.003)
    rows = {r["doc_id"]: r for r in language.classify(df, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert all(rows[i]["rejected"] and rows[i]["score"] == 0 for i in (1, 2, 3))
    assert rows[8]["lang_pred"] == "en" and rows[None]["lang_pred"] == "en" and len(LONG) > 1_000_000
    assert language.classify(df, model).count() == df.count()
    assert language.classify(empty_docs(spark), model).count() == 0
    assert language.learn(empty_docs(spark)).dictionaries == {}
    assert {r["lang_pred"] for r in language.classify(df, language.Languages({}, 0.0)).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.classify(df.filter("doc_id = 8"), language.Languages({"xx": b"abc"}, 0.003)).collect()} == {"xx"}


def test_held_out_is_crc32(spark):
    import zlib

    got = {r["id"]: r["h"] for r in spark.range(200).select("id", language.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_learning_is_bounded_and_leaves_out_what_it_must(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 500, "a" if i % 2 else None) for i in range(300)], "doc_id long, text string, lang string")
    got = language.learn(df, sample_rows=10, margin_rows=2, row_bytes=100, dictionary_bytes=500).dictionaries
    assert list(got) == ["a"] and len(got["a"]) == 500
    with pytest.raises(ValueError):
        language.learn(spark.createDataFrame([(i, "t", str(i)) for i in range(9)], "doc_id long, text string, lang string"), sample_rows=1, margin_rows=0, max_languages=8)


@pytest.mark.skipif(not os.path.exists(SF), reason="no sample tables")
def test_other_languages_and_gibberish_are_rejected(spark):
    """Texts in no learned language, of 60 to 200 words; and the labelled rows themselves, hardly any of which may go."""
    rng = random.Random(2)
    italian = "lo il la di che non per una sono con del anche come nella casa tempo molto vita giorno essere fatto dopo prima stato ancora quando sempre tutto mondo grande".split()
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 200)))) for i in range(100)]
    rows += [(100 + i, " ".join(rng.choice(italian) for _ in range(rng.randint(60, 200)))) for i in range(100)]
    docs = spark.read.parquet(SF)
    learned = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    gone = {r["doc_id"] for r in language.classify(spark.createDataFrame(rows, "doc_id long, text string"), learned).filter("rejected").collect()}
    assert len([i for i in gone if i < 100]) >= 90 and len([i for i in gone if i >= 100]) >= 60
    long = docs.filter("n_chars > 300")
    assert language.classify(long, learned).filter("not rejected").count() >= 0.99 * long.count()


def test_one_rule_for_all_lengths():
    tools = language.Compressors({"en": b"the house of the man and the ship " * 9, "fr": b"la maison de la femme et le bateau " * 9}, 6, 1024)
    words = "the man and the house of the ship ".encode() * 80
    for n in (3, 100, 255, 256, 257, 1279, 1280, 1281, 2500):
        name, margin = tools.judge(words[:n])
        assert name == "en" and 0 <= margin < 1
        assert tools.sizes(words[:n]).shape == (2,)


def test_numerals_are_no_letters():
    assert [language.has_letter(t) for t in ("½", "²", "Ⅷ", "", "1_2", "½ é", "ß", "字")] == [False] * 5 + [True] * 3
