"""Byte-level BPE encoding and decoding: a minimal perfect hash over a heap of merges.

Text is cut by the vocabulary's pattern into pre-tokens.  The first tier resolves a pre-token
that is in the vocabulary as a whole: a minimal perfect hash gives its only possible slot, and
one comparison of bytes decides.  The second tier takes the misses: their bytes form a linked
list, and a heap gives the next pair to merge, lowest rank first, leftmost among equals.
Ranks of merged pairs come from the same hash, so the vocabulary is held once.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylens.llm.common import TOKENIZERS, append_columns, read_bytes

RANKS = "byte_bpe_50k.tiktoken"
BUCKET_KEYS = 4
SHIFTS_AT_ONCE = 256
CACHED_PIECES = 500_000
CACHED_PAIRS = 500_000
CACHED_LENGTH = 64
SLICE_CHARS = 1 << 20

_MASK = (1 << 64) - 1
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def key_hash(key: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key, seed=seed)


def _slot(h: int, shift: int, size: int) -> int:
    return ((((h ^ (shift * _STEP)) * _MIX) & _MASK) >> 32) % size


def hash_shifts(keys: list[bytes]) -> tuple[int, np.ndarray]:
    """(seed, shifts) of a minimal perfect hash of distinct keys: hash, displace.

    Keys fall into buckets; from the largest bucket on, each looks for the first shift that puts
    all its keys into free slots.  A bucket of one key names its slot instead, as ``-slot - 1``.
    """
    size = len(keys)
    buckets = max(1, -(-size // BUCKET_KEYS))
    seed = 0
    while True:
        hashes = np.array([key_hash(k, seed) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) == size:
            break
        seed += 1  # two keys with one hash could never be told apart
    owner = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=buckets)
    starts = np.cumsum(counts) - counts
    shifts = np.zeros(buckets, dtype=np.int64)
    free = np.ones(size, dtype=bool)
    largest_first = np.argsort(-counts, kind="stable")
    for bucket in largest_first[counts[largest_first] > 1].tolist():
        own = hashes[order[starts[bucket] : starts[bucket] + counts[bucket]]]
        base = 0
        while True:
            tried = np.arange(base, base + SHIFTS_AT_ONCE, dtype=np.uint64)
            slots = ((own[:, None] ^ (tried * np.uint64(_STEP))) * np.uint64(_MIX) >> np.uint64(32)) % np.uint64(size)
            slots = np.sort(slots.astype(np.int64), axis=0)
            fits = free[slots].all(axis=0) & (slots[1:] != slots[:-1]).all(axis=0)
            if fits.any():
                found = int(np.argmax(fits))
                shifts[bucket] = base + found
                free[slots[:, found]] = False
                break
            base += SHIFTS_AT_ONCE
    shifts[largest_first[counts[largest_first] == 1]] = -np.flatnonzero(free) - 1
    return seed, shifts


@cache
def _driver_shifts(content: bytes) -> tuple[int, bytes]:
    seed, shifts = hash_shifts(list(read_ranks(content)))
    return seed, shifts.tobytes()


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks, of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Vocabulary:
    """The tokens of a rank file behind a minimal perfect hash."""

    def __init__(self, content: bytes, seed: int, shifts: bytes):
        ranks = read_ranks(content)
        self.size = len(ranks)
        self.seed = seed
        self.shifts = np.frombuffer(shifts, dtype=np.int64).tolist()
        self.slots: list[tuple[bytes, int] | None] = [None] * self.size
        for token, rank in ranks.items():
            self.slots[self._place(token)] = (token, rank)
        self.longest = max(map(len, ranks))
        self.raw = {rank: token for token, rank in ranks.items()}

    def _place(self, key: bytes) -> int:
        h = key_hash(key, self.seed)
        shift = self.shifts[h % len(self.shifts)]
        return -shift - 1 if shift < 0 else _slot(h, shift, self.size)

    def rank(self, key: bytes) -> int:
        """The rank of a token, -1 of anything else."""
        token, rank = self.slots[self._place(key)]
        return rank if token == key else -1


def ascii_pattern(pattern: str) -> str:
    """The same pattern for texts of ASCII characters only, without classes of Unicode."""
    letters, digits, white = "A-Za-z", "0-9", r"\t\n\x0b\x0c\r "
    other = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]")
    return other.replace(r"\p{N}", f"[{digits}]").replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")


class _PairRanks(dict):
    """Ranks of the byte strings that merges have asked for, each looked up once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, key: bytes) -> int:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        rank = self[key] = self.vocabulary.rank(key)
        return rank


class PairCoder:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, content: bytes, seed: int, shifts: bytes, pattern: str):
        import regex
        from public_tokenizers import PATTERN

        self.vocabulary = Vocabulary(content, seed, shifts)
        self.find = regex.compile(pattern).findall
        # The pattern that comes with the files has a plainer form where no other characters are.
        self.find_ascii = re.compile(ascii_pattern(pattern)).findall if pattern == PATTERN else self.find
        self.known: dict[str, bytes] = {}
        self.pairs = _PairRanks(self.vocabulary)

    def merge(self, piece: bytes) -> list[int]:
        """The second tier: ranks of a pre-token that is not in the vocabulary."""
        ranks, longest, n = self.pairs, self.vocabulary.longest, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n))  # beginning of the part before the one that begins here
        end.append(n + longest + 1)
        tokens = [ranks[piece[i : i + 1]] for i in range(n)]  # of the part that begins here
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks[piece[i : i + 2]]) >= 0]
        heapify(heap)
        while heap:
            token, start, stop = heappop(heap)
            middle = end[start]  # 0 where no part begins any more
            if not middle or middle >= stop or end[middle] != stop:
                continue  # one of the two parts has grown since
            end[middle] = 0
            end[start] = stop
            tokens[start] = token
            before[stop] = start
            after, left = end[stop], before[start]
            if after - start <= longest and after <= n and (r := ranks[piece[start:after]]) >= 0:
                heappush(heap, (r, start, after))
            if left >= 0 and stop - left <= longest and (r := ranks[piece[left:stop]]) >= 0:
                heappush(heap, (r, left, stop))
        found = [token for token, stop in zip(tokens, end, strict=False) if stop]
        if min(found) < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        return found

    def piece_ids(self, piece: str) -> bytes:
        """Packed ids of one pre-token."""
        raw = piece.encode()
        whole = self.vocabulary.rank(raw) if len(raw) <= self.vocabulary.longest else -1
        ids = array("I", [whole] if whole >= 0 else self.merge(raw))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of bounded length.

        The last match of a slice may go on behind it and is found again in the next one.  The
        pattern must match every character, as those of byte-level vocabularies do.
        """
        at, size, n = 0, SLICE_CHARS, len(text)
        find = self.find_ascii if text.isascii() else self.find
        while at < n:
            stop = min(at + size, n)
            found = find(text, at, stop)
            if stop < n:
                found.pop()
                if not found:
                    size *= 2
                    continue
            yield found
            at = at + sum(map(len, found)) if stop < n else n
            size = SLICE_CHARS

    def encode(self, text: str) -> bytes:
        """Packed ids of a text: little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for parts in self.pieces(text):
            if len(known) > CACHED_PIECES:
                known.clear()
            own = {}
            for piece in set(parts).difference(known):
                (known if len(piece) <= CACHED_LENGTH else own)[piece] = self.piece_ids(piece)
            look = (lambda p, own=own: own[p] if p in own else known[p]) if own else known.__getitem__
            out.append(b"".join(map(look, parts)))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids; an unknown id is an error."""
        return b"".join(map(self.vocabulary.raw.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_coders: dict[tuple, PairCoder] = {}


def coder(*made_of) -> PairCoder:
    """The worker's coder; what it remembers serves later tasks too."""
    if made_of not in _coders:
        _coders[made_of] = PairCoder(*made_of)
    return _coders[made_of]


def coder_parts(tokenizers: str = TOKENIZERS, ranks: str = RANKS, pattern: str | None = None) -> tuple:
    """What a task needs to make the coder; the hash is built once, on the driver.

    ``pattern`` None is the one that comes with the vocabulary files.
    """
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    content = read_bytes(f"{tokenizers}/{ranks}")
    return (content, *_driver_shifts(content), pattern)


def _id_lists(packed: list[bytes | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) // 4 for x in packed]
    values = np.frombuffer(b"".join(x for x in packed if x), dtype="<u4").astype(np.int32)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in packed], pa.bool_()))


def encode_bytes(docs: DataFrame, text: str = "text", **vocabulary) -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens``; ``vocabulary`` as for :func:`coder_parts`.

    Strings of special tokens are ordinary text.  Nulls: a null text has null ids and a null
    count; an empty text has no ids and count 0.  Texts are encoded whole, whatever their
    length; a long run without a break is one pre-token and costs n log n.  Repeated rows get
    equal ids, an empty table stays empty, and an input column named like a result is replaced.
    """
    parts = coder_parts(**vocabulary)
    added = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def make():
        own = coder(*parts)

        def compute(texts: pa.Array) -> list:
            packed = [None if x is None else own.encode(x) for x in texts.to_pylist()]
            return [_id_lists(packed), pa.array([None if x is None else len(x) // 4 for x in packed], pa.int64())]

        return compute

    return append_columns(docs, [text], added, make)


def decode_bytes(rows: DataFrame, ids: str = "token_ids", out: str = "decoded", **vocabulary) -> DataFrame:
    """``rows`` with the bytes of their ids in ``out``; null ids give null, an unknown id is an error."""
    parts = coder_parts(**vocabulary)

    def make():
        own = coder(*parts)

        def compute(lists: pa.Array) -> list:
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            found, at = [], 0
            for size in lists.value_lengths().to_pylist():
                found.append(None if size is None else own.decode(values[at : at + size].tobytes()))
                at += size or 0
            return [pa.array(found, pa.binary())]

        return compute

    return append_columns(rows, [ids], T.StructType([T.StructField(out, T.BinaryType())]), make)


def encode_and_decode(docs: DataFrame, text: str = "text", **vocabulary) -> DataFrame:
    """``docs`` with ``n_tokens``, ``packed_ids`` and ``decoded``, in one pass with one coder a task.

    ``packed_ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes they stand
    for.  Otherwise as :func:`encode_bytes`.
    """
    parts = coder_parts(**vocabulary)
    added = T.StructType(
        [T.StructField("n_tokens", T.LongType()), T.StructField("packed_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    )

    def make():
        own = coder(*parts)

        def compute(texts: pa.Array) -> list:
            packed = [None if x is None else own.encode(x) for x in texts.to_pylist()]
            counts = [None if x is None else len(x) // 4 for x in packed]
            decoded = [None if x is None else own.decode(x) for x in packed]
            return [pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())]

        return compute

    return append_columns(docs, [text], added, make)
