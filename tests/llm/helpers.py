"""A table of documents that has every awkward case."""

from vellum.llm.tokens import default_tokenizer  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, size string, kept boolean, key string, score double, piece int, range int, place int"
LONG = "lorem ipsum dolor " * 60_000

ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (4, "word", "en", None, 4),
    (5, "word", "fr", "b", 4),
    (6, "Two Words", "en", "b", 9),
    (7, "two words", None, "b", 9),
    (8, LONG, "en", "a", len(LONG)),
    (9, "a b 　 c\x85d \U0001f600 é ß İ", "de", "c", 20),
    (None, "no id at all", "en", "a", 12),
    (10, "twice the same row", "en", "a", 18),
    (10, "twice the same row", "en", "a", 18),
    (11, "\\ </s>[INST] <|endoftext|> \x00 �", "en", "a", 10),
]


def edge_docs(spark):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", True, "k", 0.5, 3, 7, 9) for r in ROWS], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
