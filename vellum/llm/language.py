"""Language identification by compression: the language whose raw-content dictionary makes the text smallest.

``learn`` takes a bounded sample of labelled rows: for each language the rows whose id has the least digest, ``sample_rows`` of them for
the dictionary and ``margin_rows`` others for the margin, and of each the first ``row_bytes`` bytes; a dictionary has at most ``dictionary_bytes``. At most
``max_languages`` languages are learned from (more raise an error), so dictionaries are at most 512 * 64 KiB. The margin under which a text is rejected is a
third of the margin that 95 of 100 of the other sampled rows have over their second best language, at least ``least_margin``.

``classify`` lower-cases and compresses every whole text with each language's dictionary and compares the sizes. A size is that of the text's blocks of
``block_bytes`` and of its first ``lead_bytes``, which are read from up to ``lead_starts`` of their words on, each reading counting by its length, for whole
bytes alone are too coarse for texts of a few words. The rule is one for texts of any length.
``score`` is the margin by which the second best language's size is larger, as a share of what the text costs there (0 to 1);
``rejected`` marks margins under ``margin``, and texts without a letter.

Defined results: null text and texts without a letter are ``und`` with score 0 and rejected, as is every text if no language
could be learned; ties go to the first language by code point; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_batches

_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")
_WORD = re.compile(rb"\S+")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numerals such as fractions and Roman ones are none."""
    return any(m[0].isalpha() for m in _LETTER_OR_NUMBER.finditer(text))


@dataclass
class Languages:
    """Raw-content dictionaries by language, and the margin that a sure text has at least."""

    dictionaries: dict[str, bytes]
    margin: float


class Compressors:
    """Compressed sizes of a text by language, in the order of ``names``."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block_bytes: int, lead_bytes: int = 256, lead_starts: int = 16):
        import zstandard

        self.names, self.tools = sorted(dictionaries), []
        self.block, self.lead, self.starts = block_bytes, lead_bytes, lead_starts
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> np.ndarray:
        lead = raw[: self.lead]
        at = [m.start() for m in _WORD.finditer(lead)] or [0]
        readings = [lead[i:] for i in at[:: -(-len(at) // self.starts)]]
        share = len(lead) / sum(map(len, readings))
        rest = [raw[i : i + self.block] for i in range(self.lead, len(raw), self.block)]
        return np.array([share * sum(len(t.compress(r)) for r in readings) + sum(len(t.compress(b)) for b in rest) for t in self.tools])

    def judge(self, raw: bytes) -> tuple[str, float]:
        """The language and the margin."""
        sizes = self.sizes(raw)
        order = np.argsort(sizes, kind="stable")
        return self.names[order[0]], float(1 - sizes[order[0]] / sizes[order[1]]) if len(order) > 1 else 1.0


def learn(
    docs: DataFrame, sample_rows: int = 96, margin_rows: int = 24, row_bytes: int = 1024, dictionary_bytes: int = 65_536, max_languages: int = 512, least_margin: float = 0.003, level: int = 6, block_bytes: int = 1024
) -> Languages:
    """Dictionaries and margin from rows (doc_id, text, lang)."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", F.substring(F.lower("text").cast("binary"), 1, row_bytes).alias("part"))
    digest = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    order = Window.partitionBy("lang").orderBy(digest, "doc_id", "part")
    most = sample_rows + margin_rows
    sample = labelled.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    parts: dict[str, list[bytes]] = {}
    rows = sample.select("lang", "place", "part").limit(most * max_languages + 1).collect()
    for lang, _, part in sorted(rows):
        parts.setdefault(lang, []).append(bytes(part))
    if len(parts) > max_languages or len(rows) > most * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # every fifth row is for the margin, so a language with few rows has both
    aside = sample_rows // margin_rows + 1 if margin_rows else most + 1
    dictionaries = {lang: b"\n".join(p for i, p in enumerate(ps) if (i + 1) % aside)[:dictionary_bytes] for lang, ps in parts.items()}
    margins = []
    if len(parts) > 1:
        tools = Compressors(dictionaries, level, block_bytes)
        for lang, ps in parts.items():
            judged = [tools.judge(p) for p in ps[aside - 1 :: aside] if has_letter(p.decode("utf-8", "replace"))]
            margins += [margin if said == lang else 0.0 for said, margin in judged]
    return Languages(dictionaries, max(least_margin, float(np.quantile(margins, 0.05)) / 3 if margins else 0.0))


def classify(docs: DataFrame, languages: Languages, level: int = 6, block_bytes: int = 1024) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def make():
        learned = shared.value
        tools = Compressors(learned.dictionaries, level, block_bytes)

        def judge(text):
            if text is None or not tools.names or not has_letter(text):
                return "und", 0.0, True
            name, margin = tools.judge(text.lower().encode("utf-8", "replace"))
            return name, margin, margin < learned.margin

        def step(cols):
            found = [judge(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

        return step

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id):
    """Of every four ids by CRC-32 of the id as text, the one whose remainder is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
