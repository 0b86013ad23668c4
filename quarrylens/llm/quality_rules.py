"""Quality rules by tokeniser fertility.

Public vocabularies are applied to the words of a text.  Ordinary prose in a language that a
vocabulary knows needs few tokens, hardly any single bytes, and uses its tokens with a typical
spread; junk leaves these ranges.  A band per language (or per script, where the language is
unknown) says what is still accepted.
"""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylens.llm.common import TOKENIZERS, append_columns, read_bytes

# The published pre-tokenisation pattern of byte-level BPE vocabularies.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# White space as that pattern has it.  Its matcher keeps a state for each character of a run and has room for a million.
WHITE_RUN = 1 << 16
_WHITE_RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % WHITE_RUN)

SYMBOLS = b"#*$%&|<>"
# A short text may owe this many tokens to one foreign run, such as a number or a key, of one code point a token;
# its part of a text of FULL_TOKENS is inside the bands.
FOREIGN_RUN = 32
FULL_TOKENS = 256


@dataclass(frozen=True)
class Band:
    """What a language or script accepts.

    ``chars`` bounds the code points per token, ``byte_share`` the share of byte-fallback
    tokens, and ``spread`` the token entropy over that of as many different tokens (of 256 at
    most: beyond, the entropy of prose grows little with its length).
    """

    chars: tuple[float, float]
    byte_share: float
    spread: float


# The ranges of prose with some room on the rejecting side, by vocabulary.
BANDS: Mapping[str, Mapping[str, Band]] = {
    "byte_bpe_multi_50k.tiktoken": {
        "en": Band((2.0, 12.0), 0.1, 0.72),
        "de": Band((2.05, 12.0), 0.1, 0.72),
        "fr": Band((1.82, 12.0), 0.1, 0.72),
        "es": Band((1.88, 12.0), 0.1, 0.72),
        "LATIN": Band((1.2, 12.0), 0.2, 0.6),
        "CYRILLIC": Band((0.6, 12.0), 0.3, 0.5),
        "GREEK": Band((0.5, 12.0), 0.5, 0.5),
        "ARABIC": Band((0.5, 12.0), 0.5, 0.5),
        "CJK": Band((0.2, 4.0), 0.9, 0.4),
        "HIRAGANA": Band((0.2, 4.0), 0.9, 0.4),
        "HANGUL": Band((0.2, 4.0), 0.9, 0.4),
        "other": Band((0.1, 12.0), 1.0, 0.3),
    },
    # Made for English: other languages need more tokens, other scripts mostly bytes.
    "byte_bpe_50k.tiktoken": {
        "en": Band((1.95, 12.0), 0.1, 0.68),
        "de": Band((1.8, 12.0), 0.1, 0.68),
        "fr": Band((1.62, 12.0), 0.12, 0.68),
        "es": Band((1.58, 12.0), 0.12, 0.68),
        "LATIN": Band((1.0, 12.0), 0.3, 0.55),
        "CYRILLIC": Band((0.4, 12.0), 0.6, 0.4),
        "GREEK": Band((0.4, 12.0), 0.7, 0.4),
        "ARABIC": Band((0.4, 12.0), 0.7, 0.4),
        "CJK": Band((0.15, 4.0), 1.0, 0.3),
        "HIRAGANA": Band((0.15, 4.0), 1.0, 0.3),
        "HANGUL": Band((0.15, 4.0), 1.0, 0.3),
        "other": Band((0.1, 12.0), 1.0, 0.25),
    },
}

BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURE = T.StructType(
    [
        T.StructField("vocabulary", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("chars_per_token", T.DoubleType()),
        T.StructField("byte_share", T.DoubleType()),
        T.StructField("token_entropy", T.DoubleType()),
        T.StructField("band", T.StringType()),
    ]
)
FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in BASE_FIELDS]
    + [
        T.StructField("fertility", T.ArrayType(MEASURE)),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more in the text."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    starts = np.fromiter((i for i, w in enumerate(windows) if times[w] > 1), dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words of a UTF-8 text and its five base counts."""
    words = text.split()
    white = sum(map(text.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    points = len(text) - white if text.isascii() else len(text.decode(errors="replace")) - white
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = sum(text.count(c) for c in SYMBOLS)
    return words, (len(words), points, symbols, len(lines) - len(set(lines)), repeat_words(words))


def main_script(text: str) -> str:
    """The script most letters belong to, by the first word of their Unicode names."""
    found: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[unicodedata.name(c, "other").split()[0]] += n
    return min(found.items(), key=lambda x: (-x[1], x[0]))[0] if found else "other"


class ByteVocabulary:
    """A byte-level vocabulary of ranks; a lone byte beyond ASCII is its fallback."""

    def __init__(self, content: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.is_byte[[i for x, i in ranks.items() if len(x) == 1 and x[0] >= 0x80]] = True

    def _encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; a long run of white space is one pre-token, found without the matcher."""
        at, parts = 0, []
        for run in _WHITE_RUNS.finditer(text) if len(text) >= WHITE_RUN else ():
            # The last character of a run belongs to what follows it.
            stop = run.end() - (run.end() < len(text))
            parts += [self._encode(text[at : run.start()]), self.encoding._encode_single_piece(text[run.start() : stop])]
            at = stop
        rest = self._encode(text[at:])
        return np.concatenate([*parts, rest]).astype(rest.dtype) if parts else rest


class PieceVocabulary:
    """A SentencePiece model with byte fallback."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int64)


def load_vocabulary(name: str, content: bytes) -> ByteVocabulary | PieceVocabulary:
    return PieceVocabulary(content) if name.endswith(".model") else ByteVocabulary(content)


def entropy(ids: np.ndarray) -> float:
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum()) + 0.0


def foreign_share(n_tokens: int) -> float:
    """The part of a text of so many tokens that one foreign run may be, beyond what the bands hold."""
    return min(1.0, FOREIGN_RUN * max(0.0, 1 / n_tokens - 1 / FULL_TOKENS))


def accepts(band: Band, n_tokens: int, chars: float, byte_share: float, bits: float) -> bool:
    """Whether the measures of a text of any length lie inside the band, which is wider for short texts."""
    low, high = band.chars
    part = foreign_share(n_tokens)
    low -= part * max(0.0, low - 1.0)
    spread = (band.spread - 0.3 * part) * math.log2(min(n_tokens, FULL_TOKENS))
    return low <= chars <= high * (1 + part) and byte_share <= band.byte_share + 0.2 * part and bits >= spread


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    bands: Mapping[str, Mapping[str, Band]] = BANDS,
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """``docs`` with the base counts, the fertility measures and the verdict ``kept``.

    ``bands`` names the vocabulary files to measure with, and each one's bands; a document
    must lie inside the band of every vocabulary.  Nulls: a null text counts no words and is
    rejected; a null or unknown language falls back on the band of the text's main script, an
    unknown script on ``other``.  An empty text has no measures and fails the base rule.
    Repeated rows get equal verdicts, an empty table stays empty, and an input column named
    like a result is replaced by it.
    """
    files = {name: read_bytes(f"{tokenizers}/{name}") for name in bands}

    def make():
        vocabularies = {name: load_vocabulary(name, content) for name, content in files.items()}

        def one(raw: bytes | None, language: str | None) -> tuple:
            words, base = base_counts(raw or b"")
            n_words, points, _, _, repeated = base
            failed = n_words < 10 or 100 * repeated > 20 * n_words
            if not words:
                return (*base, [], failed, False)
            joined, measures, kept = b" ".join(words).decode(errors="replace"), [], not failed
            for name, vocabulary in vocabularies.items():
                ids = vocabulary.encode(joined)
                known = bands[name]
                band = language if language in known else main_script(joined)
                band = band if band in known else "other"
                found = (points / len(ids), float(vocabulary.is_byte[ids].mean()), entropy(ids))
                kept = kept and accepts(known[band], len(ids), *found)
                measures.append((name, len(ids), *found, band))
            return (*base, measures, failed, kept)

        def compute(texts: pa.Array, langs: pa.Array) -> list:
            rows = [one(t, x) for t, x in zip(texts.cast(pa.binary()).to_pylist(), langs.to_pylist(), strict=True)]
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]
            names = MEASURE.fieldNames()
            columns[5] = [[dict(zip(names, m, strict=True)) for m in row] for row in columns[5]]
            return columns

        return compute

    return append_columns(docs, [text, lang], FIELDS, make)
