"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass.

The automaton holds every ordinary piece.  While it reads a text, its output links name all
pieces that end at the current position; each relaxes the best score there from the position
where the piece begins.  A character that is no piece costs more than any piece and becomes
its UTF-8 bytes.  The segmentation is the one of the largest sum of piece scores.

A piece holds the blank sign only before its other characters, so the best segmentation of a
text is that of its blank-led words one by one; a word's ids are remembered for the next time.
"""

from __future__ import annotations

import re
from array import array
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylens.llm.common import TOKENIZERS, append_columns, read_bytes

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_COST = 10.0  # below the least score of a piece
CACHED_SEGMENTS = 200_000
CACHED_LENGTH = 64


class PieceDecoder:
    """Decoder of one model; ``content`` is the model file's bytes."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.raw = [b""] * model.get_piece_size()
        for i in range(len(self.raw)):
            if model.is_byte(i):
                self.raw[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif self.is_text(i):
                self.raw[i] = model.id_to_piece(i).replace(BLANK, " ").encode()

    def is_text(self, i: int) -> bool:
        model = self.model
        return not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


class PieceCoder(PieceDecoder):
    """Encoder and decoder of one model."""

    def __init__(self, content: bytes):
        import ahocorasick

        super().__init__(content)
        self.byte_ids = [0] * 256
        self.lengths = [0] * len(self.raw)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        single, scores, separable = set(), [], True
        for i, raw in enumerate(self.raw):
            if self.model.is_byte(i):
                self.byte_ids[raw[0]] = i
            elif self.is_text(i):
                text = raw.decode()
                self.lengths[i] = len(text)
                self.automaton.add_word(text, (len(text), self.model.get_score(i), i))
                scores.append(self.model.get_score(i))
                separable = separable and " " not in text.lstrip(" ")
                if len(text) == 1:
                    single.add(text)
        self.automaton.make_automaton()
        self.single = frozenset(single)
        self.unknown = min(scores) - UNKNOWN_COST
        # A line feed that is in no piece always stands alone, so it cuts the text as well.
        breaks = not any(b"\n" in x for x in self.raw if len(x) > 1) and "\n" not in single
        self.cutter = re.compile(r"\n| *[^ \n]+| +" if breaks else r" *[^ ]+| +") if separable else None
        self.known: dict[str, bytes] = {}

    def segment(self, text: str) -> bytes:
        """Ids of one segment as int32 bytes: the Viterbi pass."""
        if not self.single.issuperset(text):
            return self._segment_with_bytes(text)
        n = len(text)
        best = [0.0] + [-inf] * n
        came = [0] * (n + 1)
        for last, (length, gain, piece) in self.automaton.iter(text):
            end = last + 1
            score = best[end - length] + gain
            if score > best[end]:
                best[end] = score
                came[end] = piece
        ids, lengths = [], self.lengths
        while n:
            piece = came[n]
            ids.append(piece)
            n -= lengths[piece]
        return array("i", reversed(ids)).tobytes()

    def _segment_with_bytes(self, text: str) -> bytes:
        """The same for a text with characters that are no piece: each may become its bytes."""
        single, unknown = self.single, self.unknown
        n = len(text)
        best = [0.0] + [-inf] * n
        came = [-1] * (n + 1)
        filled = 0
        ends = [*self.automaton.iter(text), (n, None)]
        for last, found in ends:
            # All positions before this match's end are final once their byte steps are made.
            while filled < min(last, n):
                if text[filled] not in single and best[filled] + unknown > best[filled + 1]:
                    best[filled + 1], came[filled + 1] = best[filled] + unknown, -1
                filled += 1
            if found is not None:
                length, gain, piece = found
                score = best[last + 1 - length] + gain
                if score > best[last + 1]:
                    best[last + 1], came[last + 1] = score, piece
        ids, lengths = [], self.lengths
        while n:
            piece = came[n]
            if piece >= 0:
                ids.append(piece)
                n -= lengths[piece]
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
                n -= 1
        return array("i", reversed(ids)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; its own blank signs become bytes, so that decoding gives them back."""
        if not text:
            return np.empty(0, dtype=np.int32)
        full = " " + text
        parts = self.cutter.findall(full) if self.cutter else [full]
        if len(self.known) > CACHED_SEGMENTS:
            self.known.clear()
        known = self.known
        new = set(parts).difference(known)
        own = {}
        for part in new:
            (known if len(part) <= CACHED_LENGTH else own)[part] = self.segment(part)
        if own:
            found = b"".join([own[p] if p in own else known[p] for p in parts])
        else:
            found = b"".join(map(known.__getitem__, parts))
        return np.frombuffer(found, dtype=np.int32)


_coders: dict[bytes, PieceCoder] = {}


def coder(content: bytes) -> PieceCoder:
    """The worker's coder of this model; what it remembers serves later tasks too."""
    if content not in _coders:
        _coders[content] = PieceCoder(content)
    return _coders[content]


IDS = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]


def _id_arrays(found: list[np.ndarray | None]) -> list[pa.Array]:
    """The id lists of a batch and their lengths."""
    sizes = np.array([0 if x is None else len(x) for x in found], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.array(np.concatenate([x for x in found if x is not None] or [np.empty(0, dtype=np.int32)]))
    missing = pa.array([x is None for x in found], pa.bool_())
    lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing)
    return [lists, pa.array([None if x is None else len(x) for x in found], pa.int64())]


def encode_texts(docs: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens``.

    Nulls: a null text has null ids and null count; an empty text has no ids and count 0.
    Texts are encoded whole, whatever their length.  Repeated rows get equal ids, an empty
    table stays empty, and an input column named like a result is replaced by it.
    """
    content = read_bytes(f"{tokenizers}/{model}")

    def make():
        own = coder(content)

        def compute(texts: pa.Array) -> list:
            return _id_arrays([None if x is None else own.encode(x) for x in texts.to_pylist()])

        return compute

    return append_columns(docs, [text], T.StructType(IDS), make)


def decode_tokens(
    rows: DataFrame, ids: str = "token_ids", out: str = "decoded", tokenizers: str = TOKENIZERS, model: str = MODEL
) -> DataFrame:
    """``rows`` with the text of their ids in ``out``; null ids give null."""
    content = read_bytes(f"{tokenizers}/{model}")

    def make():
        own = PieceDecoder(content)

        def compute(lists: pa.Array) -> list:
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = [0 if x is None else x for x in lists.value_lengths().to_pylist()]
            found, at = [], 0
            for size, missing in zip(sizes, lists.is_null().to_pylist(), strict=True):
                found.append(None if missing else own.decode(values[at : at + size].tolist()))
                at += size
            return [pa.array(found, pa.string())]

        return compute

    return append_columns(rows, [ids], T.StructType([T.StructField(out, T.StringType())]), make)


def round_trip(docs: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``same``: whether decoding gives the text back.

    One pass does both, so that a task has one worker with one model; otherwise as
    :func:`encode_texts`, with ``same`` true for a null text.
    """
    content = read_bytes(f"{tokenizers}/{model}")
    added = T.StructType([*IDS, T.StructField("same", T.BooleanType())])

    def make():
        own = coder(content)

        def compute(texts: pa.Array) -> list:
            values = texts.to_pylist()
            found = [None if x is None else own.encode(x) for x in values]
            same = [x is None or own.decode(ids.tolist()) == x for x, ids in zip(values, found, strict=True)]
            return [*_id_arrays(found), pa.array(same, pa.bool_())]

        return compute

    return append_columns(docs, [text], added, make)
