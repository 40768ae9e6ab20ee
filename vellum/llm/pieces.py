"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays.

The words of a batch that were not seen before lie in one flat array of symbols with their word's number beside them. In each round every word finds its least pair
rank (a segmented minimum), merges all leftmost occurrences of pairs of that rank at once, and the arrays are compacted; words without a pair leave. Sequential BPE
would turn aside where a merged symbol makes a pair of the same or a lesser rank with a neighbour (a piece may have been learned before its parts): such a word takes the merges up to
that place and no more in this round, which gives exactly the sequential result.

Words are cut before runs of spaces, for the model has no piece with a space after another character (checked as it is read), and around characters that are in no piece.
Characters without a piece become the pieces of their UTF-8 bytes. Decoding looks up all pieces' bytes with one gather a batch.

Defined results: null and empty text have no ids; null or empty ids give an empty text; U+2581 is a space to the model, as in the library; bytes that are not UTF-8 are decoded to U+FFFD one by one;
ids outside the vocabulary are an error; repeated rows are encoded each; ties of rank go to the left; columns other than those named are ignored; an empty table gives no rows.
Models that are not BPE, normalise their text or have user-defined or unused pieces are an error.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import CACHE_ENTRIES, map_batches

SPACE = "▁"
#: Characters up to which a word's ids are remembered for later batches.
_SHORT = 48
#: Ids that one round of decoding gathers at once.
_IDS_AT_ONCE = 1 << 17


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("vellum_each_byte", _each_byte)


class PieceModel:
    """The tables of a model file: pieces, pair ranks, and bytes of pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, rule = pb.ModelProto.SentencePiece, model.normalizer_spec
        plain = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and rule.escape_whitespaces
        if not plain or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path} is no BPE model with byte fallback and plain text")
        self.prefix = " " if rule.add_dummy_prefix else ""
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(b == SPACE != a for piece in normal for a, b in zip(piece, piece[1:])):
            raise ValueError(f"{path} has pieces over several words")
        chars = sorted({c for piece in normal for c in piece})
        symbols = dict(normal)
        for c in chars:
            symbols.setdefault(c, len(model.pieces) + len(symbols) - len(normal))
        self.pieces, self.known = len(model.pieces), len(model.pieces) + len(symbols) - len(normal)
        #: Symbol of each code point; those in no piece come after all others and merge with nothing.
        self.of_char = self.known + np.arange(0x110000, dtype=np.int64)
        for c in chars:
            self.of_char[ord(c)] = symbols[c]
        self.char_of = {symbols[c]: ord(c) for c in chars}
        self._pair_tables(model, normal, symbols)
        self._byte_tables(model, kinds)
        alone = "".join(c for c in "\n\t\r" if c not in set(chars))
        self.words = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +")
        self.seen: dict[str, bytes] = {}

    def _pair_tables(self, model, normal: dict[str, int], symbols: dict[str, int]) -> None:
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        rank_of = {score: rank for rank, score in enumerate(scores)}
        rows = []
        for piece, i in normal.items():
            for at in range(1, len(piece)):
                left, right = symbols.get(piece[:at]), symbols.get(piece[at:])
                if left is not None and right is not None:
                    rows.append((left * self.known + right, i, rank_of[model.pieces[i].score]))
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.none = len(scores)
        self.keys, self.merged, self.ranks = (np.append(table[:, k], last) for k, last in enumerate((np.int64(1) << 62, -1, self.none)))

    def _byte_tables(self, model, kinds) -> None:
        self.byte_ids = np.full(256, -1, np.int64)
        surface, self.control, spaced = [], np.zeros(self.pieces, bool), np.zeros(self.pieces, bool)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                surface.append(bytes([int(p.piece[3:5], 16)]))
                self.byte_ids[surface[-1][0]] = i
            elif p.type == kinds.CONTROL:
                surface.append(b"")
                self.control[i] = True
            elif p.type == kinds.UNKNOWN:
                surface.append(model.trainer_spec.unk_surface.encode())
            else:
                surface.append(p.piece.replace(SPACE, " ").encode())
                spaced[i] = p.piece.startswith(SPACE) and bool(self.prefix)
        self.spaced = spaced
        self.length = np.array([len(s) for s in surface], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``none`` where there is no such piece."""
        key = np.where((left < self.known) & (right < self.known), left * self.known + right, -1)
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], self.none), np.where(found, self.merged[at], -1)

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and word numbers (ascending) after all merges."""
        done = []
        rank, into = np.full(len(sym), self.none), np.full(len(sym), -1)
        rank[:-1], into[:-1] = self.pairs(sym[:-1], sym[1:])
        rank[:-1][word[1:] != word[:-1]] = self.none
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = least == self.none
            if over.any():
                done.append((sym[over], word[over]))
                sym, word, rank, into, least = (a[~over] for a in (sym, word, rank, into, least))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            number = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.append(True, hit[1:] != hit[:-1] + 1), number, 0))
            take = hit[(number - run) % 2 == 0]
            take = take[self._before_a_turn(sym, word, into, least, take)]
            sym[take] = into[take]
            alive = np.ones(len(sym), bool)
            alive[take + 1] = False
            sym, word, rank, into = (a[alive] for a in (sym, word, rank, into))
            at = take - np.arange(len(take))
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            at = np.flatnonzero(changed)
            rank[at], into[at] = self.none, -1
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at], into[at] = self.pairs(sym[at], sym[at + 1])
        if not done:
            return sym, word
        sym, word = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _before_a_turn(self, sym, word, into, least, take) -> np.ndarray:
        """Which of the merges come, in their word, no later than the first that makes a pair of no greater rank with a neighbour."""
        new, last = into[take], len(sym) - 1
        left, right = np.maximum(take - 1, 0), np.minimum(take + 2, last)
        left_sym = sym[left]
        joined = np.flatnonzero(take[1:] == take[:-1] + 2) + 1
        left_sym[joined] = new[joined - 1]
        a = np.where((take > 0) & (word[left] == word[take]), self.pairs(left_sym, new)[0], self.none)
        b = np.where((take + 2 <= last) & (word[right] == word[take]), self.pairs(new, sym[right])[0], self.none)
        turns = np.minimum(a, b) <= least[take]
        before = np.cumsum(turns) - turns
        own = word[take]
        base = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), before, 0))
        return before == base

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word (not empty, spaces as SPACE), as int32."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym, word = self.merge_rounds(self.of_char[chars], word)
        if (odd := np.flatnonzero(sym >= self.pieces)).size:  # characters without a piece of their own
            raw = [chr(s - self.known if s >= self.known else self.char_of[s]).encode("utf-8", "replace") for s in sym[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            place = np.repeat(np.isin(np.arange(len(sym)), odd), times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[place] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        raw, stops = sym.astype(np.int32).tobytes(), (4 * np.searchsorted(word, np.arange(1, len(words) + 1))).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.words.findall(self.prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        new = list({w for words in cut for w in words} - self.seen.keys())
        ids = dict(zip(new, self.word_ids([w.replace(" ", SPACE) for w in new]))) if new else {}
        self.seen.update((w, i) for w, i in ids.items() if len(w) <= _SHORT)
        if any(len(w) > _SHORT for w in ids):
            return [np.frombuffer(b"".join([ids[w] if len(w) > _SHORT else self.seen[w] for w in words]), np.int32) for words in cut]
        of = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of ids that lie one text after another."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.pieces):
            raise ValueError("ids outside the vocabulary")
        size, start = self.length[ids], self.start[ids]
        ends = np.cumsum(lengths)
        seen = np.flatnonzero(~self.control[ids])  # a text's first piece that shows loses the space of the prefix
        at = np.searchsorted(seen, ends - lengths)
        lead = seen[np.minimum(at, len(seen) - 1)] if len(seen) else seen
        lead = lead[(at < len(seen)) & (lead < ends)] if len(seen) else seen
        lead = lead[self.spaced[ids[lead]]]
        start[lead] += 1
        size[lead] -= 1
        to = np.cumsum(size)
        gather = np.repeat(start - (to - size), size) + np.arange(to[-1] if len(to) else 0)
        raw = self.bytes[gather].tobytes()
        stops = np.append(0, to)[ends].tolist()
        silent = np.flatnonzero(self.control[ids])
        if not silent.size:
            return [raw[a:b].decode("utf-8", "vellum_each_byte") for a, b in zip([0, *stops], stops)]
        cuts, out = np.sort(np.concatenate([to[silent], stops])).tolist(), []  # a piece without text ends a character all the same
        runs = iter(zip([0, *cuts], cuts, np.sort(np.concatenate([silent, ends - 0.5])) % 1 > 0))
        for _ in stops:
            own = []
            for a, b, ended in runs:
                own.append(raw[a:b].decode("utf-8", "vellum_each_byte"))
                if ended:
                    break
            out.append("".join(own))
        return out


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(rows: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each whole text."""
    path = model or default_model()

    def make():
        tables = piece_model(path)
        return lambda cols: {key: cols[key], "ids": tables.encode(cols[text])}

    return map_batches(rows.select(key, text), make, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, model: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows with the text of their ids."""
    from pyspark.sql.types import StringType, StructField, StructType

    path, schema = model or default_model(), StructType([*rows.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = piece_model(path)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, texts, first = np.cumsum(lengths), [], 0
            while first < len(lengths):
                begin = ends[first] - lengths[first]
                last = max(first + 1, int(np.searchsorted(ends, begin + _IDS_AT_ONCE)))
                flat = column.slice(first, last - first).flatten().to_numpy(zero_copy_only=False)
                texts += tables.decode(flat.astype(np.int64), lengths[first:last])
                first = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
