"""Token ids of whole texts with a public tokenizer file, by way of bounded per-worker tables of words and of their pieces.

The file's normalizer and pre-tokenizer never join what ASCII white space parts, so a text's ids are its words' ids in a row;
``tests/llm`` holds this against encoding whole texts. Words outside the plain alphabet below go through the tokenizer itself.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import pyarrow as pa
import pyarrow.compute as pc

from .arrow import WordTable

#: Entries of the tables of words and of pieces. A piece stands in several words (word, Word, "word,"), and costs the most to work out.
_WORDS, _PIECE_ENTRIES = 100_000, 400_000
#: Lower-case letters whose normal form, case and class all engines agree on.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Letters with one mark after them at most, which are a piece each.
_ENDS = ".,;:!?"
_ENDED = rf"^[A-Za-z]+[{_ENDS}]?$"
#: The tokenizer file's own split pattern, for words of the alphabet above.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE shows printable Latin-1 bytes as themselves and the others as code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """``ids(text)`` gives the bytes of a text's ids as little-endian uint32; with ``ordinary_specials``, special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, ordinary_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = ordinary_specials
        self.model = self.whole.model
        self.alphabet = _byte_alphabet()
        self.table = WordTable(self._word, _WORDS)
        self.pieces = WordTable(self._piece, _PIECE_ENTRIES)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        return _little_endian([t.id for t in self.model.tokenize(piece)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        lower = text.lower()
        if lower.isalpha() and _PLAIN.fullmatch(text):
            return self.pieces[lower]
        if "<|" in text or not _PLAIN.fullmatch(text):
            return _little_endian(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(self.pieces[piece] for piece in _PIECES.findall(lower))

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.table.__getitem__, (text or "").encode("utf-8", "replace").split()))

    def ids_of(self, texts: pa.Array) -> pa.Array:
        """``ids`` of each text of a string array, as large binaries. Arrow splits the texts and tells words apart, so each is looked up once for all of them, and plain words by their lower-case letters."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        plain = pc.match_substring_regex(coded.dictionary, _ENDED)
        lower = pc.ascii_lower(coded.dictionary.filter(plain))
        stems = pc.ascii_rtrim(lower, _ENDS)
        bare = pc.equal(pc.binary_length(stems), pc.binary_length(lower))
        ends = pc.if_else(bare, pa.scalar("", pa.large_string()), pc.utf8_slice_codeunits(lower, -1))
        joined = pc.binary_join_element_wise(self._looked_up(stems, self.pieces), self._looked_up(ends, self.pieces), pa.scalar(b"", pa.large_binary()))
        others = [self.table[w.encode()] for w in coded.dictionary.filter(pc.invert(plain)).to_pylist()]
        known = pc.replace_with_mask(pa.nulls(len(plain), pa.large_binary()), plain, joined)
        known = pc.replace_with_mask(known, pc.invert(plain), pa.array(others, pa.large_binary()))
        at = pc.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int64()), pc.list_value_length(words).cast(pa.int64())]))
        return pc.binary_join(pa.LargeListArray.from_arrays(at, known.take(coded.indices)), pa.scalar(b"", pa.large_binary()))

    @staticmethod
    def _looked_up(words: pa.Array, table: WordTable) -> pa.Array:
        coded = words.dictionary_encode()
        return pa.array([table[w] if w else b"" for w in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
