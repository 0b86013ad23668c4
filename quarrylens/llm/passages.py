"""Substring dedup: repeated passages, lines and sentences removed, the earliest occurrence kept.

The normalised units' digests (64 bits; windows 64 and 64 of their anchor; 128 bits with a ``unit``) are
grouped over all documents, and every occurrence but the earliest ranked one is a repeat.  Units are whole lines, paragraphs and documents of any
length, the sentences of lines, whose runs of enough words are repeats, and windows of
``WINDOW_WORDS`` words at every word.  So a passage is found wherever its ends stand in a
sentence, and a short sentence that many documents share inside longer lines stays.

The first reading of the texts counts one 64-bit hash per unit and finds the least rank of its
documents.  The repeated hashes go into a filter of fixed size; the second reading writes only the
units that pass it, once, and joins them with their first places.  Windows are not written for
every word either.  Each has an anchor, the run of ``ANCHOR_WORDS`` words in it with the least hash;
equal windows have equal anchors, so only windows whose anchor passes the filter matter, and no
repeated window is missed.  The windows of one anchor follow each other and are one row, a pack; equal
packs are compared as one, and single windows only where an anchor has several different packs.
A document that is a copy as a whole is one repeat and holds no earliest unit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quarrylens.llm.common import append_columns, written
from quarrylens.operators.lineage import cut

PASSAGE_WORDS = 25
UNITS = {
    "paragraph": re.compile(r"\S(?:[^\n]|\n(?![ \t]*(?:\n|\Z)))*+"),
    "line": re.compile(r"\S[^\n]*+"),
    # A sentence ends with its marks before white space, and with its line.
    "sentence": re.compile(r"[^\s.!?][^.!?\n]*+(?:[.!?]++(?!\s)[^.!?\n]*+)*+[.!?]*+|[.!?]++"),
}
LAST_ID = 2**63 - 1
WINDOW_WORDS = 50
ANCHOR_WORDS = 40
# Kinds of units; units of different kinds never match.
RUN, WHOLE, ANCHOR, WINDOW = range(4)
KIND_KEYS = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x27BB2EE687B0B0FD], dtype=np.int64)
# Bits of the filters that the tasks get; with more keys a filter lets more pass, and nothing else changes.
FILTER_BITS = 1 << 26
BITMAP_BITS = 1 << 15
BLOCK_CODES = 1 << 20
# Code points of the texts that are read at once.
GROUP_CODES = 1 << 17
# What a document adds to the count of its hash, beside one for the unit.
DOCUMENT = 1 << 40
POSITION = np.uint64(2**28 - 1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WHITE = np.array([chr(i).isspace() for i in range(0x3002)])


def normalised(unit: str) -> list[str]:
    """The words of a unit in one spelling: compatibility forms and case are equal."""
    return (unit if unit.isascii() else unicodedata.normalize("NFKC", unit)).lower().split()


def units_of(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit, in code points of the text."""
    for found in pattern.finditer(text):
        words = normalised(found[0])
        if words:
            yield found.start(), found.end(), len(words), xxhash.xxh3_128_digest(" ".join(words).encode())


def _codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a text, and the starts and ends of its words."""
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    white = np.ones(len(codes) + 2, dtype=bool)
    white[1:-1] = WHITE[codes if codes.dtype == np.uint8 else np.minimum(codes, len(WHITE) - 1)]
    edges = (white[1:] != white[:-1]).nonzero()[0]
    return codes, edges[::2], edges[1::2]


def _begins(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0]


def _numbers(x: np.ndarray) -> np.ndarray:
    """The number of each value within its run of equal values."""
    begins = _begins(x) if len(x) else np.zeros(0, dtype=np.int64)
    return np.arange(len(x)) - np.repeat(begins, np.diff(begins, append=len(x)))


def _parts_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The part in which each start lies, of parts that end at ``ends``."""
    return np.repeat(np.arange(len(ends)), np.diff(starts.searchsorted(ends), prepend=0))


def _spelling(text: str) -> str:
    """A text of as many words, in their one spelling."""
    if text.isascii() or unicodedata.is_normalized("NFKC", text):
        return text.lower()
    # A word with white space in its compatibility form stays one word.
    return " ".join("\0".join(normalised(x)) or "\0" for x in text.split())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts, their offsets, and digests of any run of them in constant time.

    A word's digest is a mixed polynomial of its code points modulo 2**64, in two halves of
    different bases; a run's is one of its words' digests.  A half is made when it is asked for.
    Texts are read many at once, so that short ones cost little more than their code points; no
    line, and so no unit, lies in two of them.
    """

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones((2, 0), dtype=np.uint64)

    def _sums(self, values: np.ndarray, half: int) -> np.ndarray:
        n = len(values)
        if n >= self.powers.shape[1]:
            size = 1 << (n + 1).bit_length()
            steps = np.ones((4, size), dtype=np.uint64)
            steps[:, 1:] = np.array([[b % 2**64] for b in (*BASES, *[pow(b, -1, 2**64) for b in BASES])], dtype=np.uint64)
            self.powers, self.inverses = np.split(np.cumprod(steps, axis=1, dtype=np.uint64), 2)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.powers[half, :n] * values, out=sums[1:])
        return sums

    def _runs(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray, half: int) -> np.ndarray:
        return (sums[last] - sums[first]) * self.inverses[half][first]

    def _word_digests(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, half: int) -> np.ndarray:
        found = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):
            # Whole words of about a block: a long text takes no more memory than that at once.
            begin = int(starts[at])
            stop = max(at + 1, int(np.searchsorted(ends, begin + BLOCK_CODES, "right")))
            # A code point counts from 1, so that none is without effect.
            sums = self._sums(codes[begin : int(ends[stop - 1])].astype(np.uint64) + np.uint64(1), half)
            found[at:stop] = _mixed(self._runs(sums, starts[at:stop] - begin, ends[at:stop] - begin, half))
            at = stop
        return found

    def read(self, text: str, stops: np.ndarray | None = None) -> None:
        """Read a text, or several joined by line feeds, which end at ``stops``."""
        self.codes, self.starts, self.ends = _codes(text)
        self.stops = np.array([len(self.codes)]) if stops is None else stops
        self.offsets = np.concatenate([[0], self.stops[:-1] + 1])
        self.text = _parts_of(self.starts, self.stops)
        self.firsts = self.starts.searchsorted(self.offsets)
        if text.isascii():
            self._spelt = np.frombuffer(text.lower().encode("ascii"), dtype=np.uint8), self.starts, self.ends
        else:
            bounds = zip(self.offsets.tolist(), self.stops.tolist(), strict=True)
            self._spelt = _codes("\n".join([_spelling(text[begin:stop]) for begin, stop in bounds]))
        self._halves: list[np.ndarray | None] = [None, None]
        self._anchors: tuple[int, np.ndarray, np.ndarray] | None = None

    def sums(self, half: int) -> np.ndarray:
        if self._halves[half] is None:
            self._halves[half] = self._sums(self._word_digests(*self._spelt, half), half)
        return self._halves[half]

    def digests(self, first: np.ndarray, last: np.ndarray, half: int) -> np.ndarray:
        """One half of the digests of the runs of words from ``first`` up to before ``last``."""
        return self._runs(self.sums(half), first, last, half).view(np.int64) if len(first) else np.zeros(0, dtype=np.int64)

    def span_digests(self, text: str, spans: np.ndarray, low: np.ndarray, high: np.ndarray, half: int) -> np.ndarray:
        """The same of the words ``low`` to ``high``, of which the first may begin before its span, or the last end after it."""
        found = self.digests(low, high, half)
        for i in ((self.starts[low] < spans[:, 0]) | (self.ends[high - 1] > spans[:, 1])).nonzero()[0]:
            own = " ".join(normalised(text[spans[i, 0] : spans[i, 1]]))
            found[i] = self._sums(self._word_digests(*_codes(own), half), half)[-1].view(np.int64)
        return found

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The line of each word, and the ends of all lines."""
        line_ends = np.append((self.codes == 10).nonzero()[0], len(self.codes))
        return _parts_of(self.starts, line_ends), line_ends

    def sentences(self, line: np.ndarray, line_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of the text's sentences, as ``UNITS`` finds them, and their first and last words."""
        # A sentence ends after a word that ends with a mark, and with its line.
        last = self.codes[self.ends - 1]
        marked = (last == 46) | (last == 33) | (last == 63)
        begins = np.ones(len(line), dtype=bool)
        begins[1:] = marked[:-1] | (line[1:] != line[:-1])
        low = begins.nonzero()[0]
        high = np.concatenate([low[1:], [len(line)]])
        spans = np.empty((len(low), 2), dtype=np.int64)
        spans[:, 0] = self.starts[low]
        spans[:, 1] = np.where(marked[high - 1], self.ends[high - 1], line_ends[line[high - 1]])
        # Marks at the beginning of a word are a sentence of their own.
        first = self.codes[spans[:, 0]]
        parted, cuts = [], []
        for i in ((first == 46) | (first == 33) | (first == 63)).nonzero()[0].tolist():
            begin = int(spans[i, 0])
            codes = self.codes[begin : int(self.ends[low[i]])]
            other = ((codes != 46) & (codes != 33) & (codes != 63)).nonzero()[0]
            if len(other):
                parted.append(i)
                cuts.append(begin + int(other[0]))
        if parted:
            marks = np.column_stack([spans[parted, 0], cuts])
            spans[parted, 0] = cuts
            spans = np.insert(spans, parted, marks, axis=0)
            low, high = np.insert(low, parted, low[parted]), np.insert(high, parted, low[parted] + 1)
        return spans, low, high

    def paragraph_ends(self, text: str, line: np.ndarray, line_ends: np.ndarray) -> np.ndarray:
        """The line feeds before a line of nothing but spaces and tabs, and the ends of texts."""
        blank = np.ones(len(line_ends), dtype=bool)
        blank[line] = False
        empty = line_ends[1:] - line_ends[:-1] == 1
        for k in (blank[1:] & ~empty).nonzero()[0] + 1:
            blank[k] = not text[line_ends[k - 1] + 1 : line_ends[k]].strip(" \t")
        ending = np.append(blank[1:], True)
        ending[line_ends.searchsorted(self.stops)] = True
        return line_ends[ending]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts' windows of words and for each the position of its anchor: the first of its runs with the least hash."""
        if self._anchors is None or self._anchors[0] != window:
            anchor = self._find_anchors(window)
            # A window lies in one text.
            at = (self.text[: len(anchor)] == self.text[len(self.text) - len(anchor) :]).nonzero()[0]
            self._anchors = window, at, anchor[at]
        return self._anchors[1:]

    def _find_anchors(self, window: int) -> np.ndarray:
        length = min(ANCHOR_WORDS, window)
        size = max(len(self.starts) - length + 1, 0)
        sums = self.sums(0)
        least = _mixed((sums[length : length + size] - sums[:size]) * self.inverses[0, :size])
        least = (least & ~POSITION) | np.arange(len(least), dtype=np.uint64)
        wide, size = window - length + 1, 1
        if len(least) < wide:
            return np.zeros(0, dtype=np.int64)
        while size * 2 <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = wide - size
        least = np.minimum(least[: len(least) - rest], least[rest:])
        return (least & POSITION).astype(np.int64)


def _rank(doc_id: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LAST_ID))


def _part(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) >> 1


def _groups(values: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """(begin, stop, text, stops): the values in groups, joined by line feeds, and where each ends in the text."""
    begin, size = 0, 0
    for stop, value in enumerate(values, 1):
        size += len(value or "")
        if size >= GROUP_CODES or stop == len(values):
            texts = [x or "" for x in values[begin:stop]]
            yield begin, stop, "\n".join(texts), np.cumsum([len(x) + 1 for x in texts]) - 1
            begin, size = stop, 0


def _all_units(words: Words, text: str, window: int, stops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(kind, pos, word, start, end, words, text) and hashes: sentences, whole lines and more, and anchors.

    Several texts are joined by line feeds and end at ``stops``; a unit's place is that in its own text.
    """
    words.read(text, stops)
    n = len(words.starts)
    if not n:
        return np.zeros((0, 7), dtype=np.int64), np.zeros(0, dtype=np.int64)
    line, line_ends = words.lines()
    spans, low, high = words.sentences(line, line_ends)
    # Whole lines and paragraphs, one row for units of the same words; the document comes first.
    ends = words.paragraph_ends(text, line, line_ends)
    paragraph = _parts_of(words.starts, ends)
    begins = _begins(words.text), _begins(line), _begins(paragraph)
    first = np.concatenate(begins)
    until = np.concatenate([np.append(x[1:], n) for x in begins])
    stop = np.concatenate([words.ends[until[: len(begins[0])] - 1], line_ends[line[begins[1]]], ends[paragraph[begins[2]]]])
    _, kept = np.unique(first * (n + 1) + until, return_index=True)
    kept.sort()
    kept = kept[np.argsort(words.text[first[kept]], kind="stable")]
    first, until, stop = first[kept], until[kept], stop[kept]
    # The anchors of windows in order never go back.
    at = words.anchors(window)[1]
    at = at[_begins(at)] if len(at) else at
    a, b = len(low), len(low) + len(kept)
    columns, hashes = np.zeros((b + len(at), 7), dtype=np.int64), np.empty(b + len(at), dtype=np.int64)
    word = np.concatenate([low, first, at])
    own = words.text[word]
    columns[:a, 0], columns[a:b, 0], columns[b:, 0] = RUN, WHOLE, ANCHOR
    columns[:, 2], columns[:, 6] = word - words.firsts[own], own
    columns[:a, 1], columns[a:b, 1], columns[b:, 1] = _numbers(own[:a]), _numbers(own[a:b]), columns[b:, 2]
    offsets = words.offsets[own[:b]]
    columns[:a, 3:5] = spans - offsets[:a, None]
    columns[a:b, 3], columns[a:b, 4] = words.starts[first] - offsets[a:], stop - offsets[a:]
    columns[:a, 5], columns[a:b, 5] = high - low, until - first
    hashes[:a] = words.span_digests(text, spans, low, high, 0) ^ KIND_KEYS[RUN]
    hashes[a:b] = words.digests(first, until, 0) ^ KIND_KEYS[WHOLE]
    hashes[b:] = words.digests(at, at + min(ANCHOR_WORDS, window), 0) ^ KIND_KEYS[ANCHOR]
    return columns, hashes


def _second_halves(words: Words, text: str, rows: np.ndarray) -> np.ndarray:
    """The other half of the digests of sentences and wholes, which only units that may be repeated need."""
    low = rows[:, 2] + words.firsts[rows[:, 6]]
    found = words.digests(low, low + rows[:, 5], 1)
    runs = np.flatnonzero(rows[:, 0] == RUN)
    own, low = rows[runs], low[runs]
    found[runs] = words.span_digests(text, own[:, 3:5] + words.offsets[own[:, 6], None], low, low + own[:, 5], 1)
    return found ^ KIND_KEYS[rows[:, 0]]


def _windows(words: Words, anchors: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows that have one of these anchors, as the anchors' packs.

    Gives the packs' bounds in the list of windows, their anchors' hashes, and the windows' positions and hashes.
    """
    known = np.zeros(len(words.starts) + 1, dtype=bool)
    known[anchors] = True
    at, anchor = words.anchors(window)
    passing = known[anchor]
    at, anchor = at[passing], anchor[passing]
    begins = _begins(anchor)
    heads = words.digests(anchor[begins], anchor[begins] + min(ANCHOR_WORDS, window), 0) ^ KIND_KEYS[WINDOW]
    return np.append(begins, len(at)), heads, at, words.digests(at, at + window, 1)


def _places(keys: np.ndarray) -> list[np.ndarray]:
    """The two bits of each 64-bit key in a filter."""
    mixed = _mixed(keys.astype(np.int64).view(np.uint64))
    return [(mixed & np.uint64(FILTER_BITS - 1)).astype(np.int64), (mixed >> np.uint64(38)).astype(np.int64) % FILTER_BITS]


def _owner_keys(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A key of a unit in the documents of one rank."""
    return (_mixed(_mixed(rank.astype(np.int64).view(np.uint64))) ^ h.astype(np.int64).view(np.uint64)).view(np.int64)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter lets pass: all that were set, and few others."""
    out = np.ones(len(keys), dtype=bool)
    for place in _places(keys):
        out &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


def _filter_of(keys: DataFrame) -> np.ndarray:
    """The bits of (key): at most ``FILTER_BITS / BITMAP_BITS`` bitmaps come to the driver, 8 MB in all."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _places(batch.column(0).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["place"])

    places = keys.mapInArrow(place, "place bigint")
    bucket = F.expr(f"place div {BITMAP_BITS}").alias("bucket")
    maps = places.groupBy(bucket).agg(F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in maps.collect():
        own = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        bits[row["bucket"] * BITMAP_BITS // 8 :][: len(own)] = own
    return bits


def _counted(docs: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """(h, n, rank): the hashes of units that occur more than once, and of all whole documents.

    ``n`` counts the units, and ``DOCUMENT`` more for each document; ``rank`` is the least one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()

        def flush(found: list) -> pa.RecordBatch:
            hashes, counts, ranks = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*found, strict=True))
            order = np.argsort(hashes)
            hashes = hashes[order]
            begins = _begins(hashes)
            columns = hashes[begins], np.add.reduceat(counts[order], begins), np.minimum.reduceat(ranks[order], begins)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "n", "rank"])

        for batch in batches:
            found, size = [], 0
            rank = batch.column(0).to_numpy()
            for begin, stop, joined, stops in _groups(batch.column(1).to_pylist()):
                rows, hashes = _all_units(words, joined, window, stops)
                if not len(rows):
                    continue
                document = (rows[:, 0] == WHOLE) & (rows[:, 1] == 0)
                found.append((hashes, np.where(document, DOCUMENT + 1, 1), rank[begin:stop][rows[:, 6]]))
                size += len(hashes)
                if size > 200_000:
                    yield flush(found)
                    found, size = [], 0
            if found:
                yield flush(found)

    found = docs.select(_rank(doc_id), F.col(f"`{text}`")).mapInArrow(run, "h bigint, n bigint, rank bigint")
    return found.groupBy("h").agg(F.sum("n").alias("n"), F.min("rank").alias("rank")).filter(f"n % {DOCUMENT} > 1 OR n >= {DOCUMENT}")


PACKED_ROWS = (
    "kind int, rank bigint, part bigint, pos int, word int, words int, start int, end int, again boolean, "
    "h1 bigint, h2 bigint, hashes array<bigint>, starts array<int>, ends array<int>"
)


def _passing_units(
    docs: DataFrame,
    doc_id: str,
    text: str,
    window: int,
    repeated: np.ndarray,
    documents: np.ndarray,
    shared: np.ndarray,
) -> DataFrame:
    """The units that may be repeated: sentences, wholes, and packs of windows with their hashes and offsets.

    The filters hold the repeated hashes, the first documents among equal ones, and the ranks of several rows.
    ``part`` tells the texts of such a rank apart and is 0 elsewhere; ``again`` marks a unit that an
    equal one precedes in its document.
    """
    names = [x.split()[0] for x in PACKED_ROWS.split(", ")]

    def lists(values: list[np.ndarray], sizes: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *sizes]))])
        flat = pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *values])).cast(kind)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)

    def flush(columns: list[np.ndarray], sizes: list, values: list) -> pa.RecordBatch:
        rows = np.vstack([np.zeros((0, 11), dtype=np.int64), *columns])
        wide = {1: pa.int64(), 2: pa.int64(), 8: pa.bool_(), 9: pa.int64(), 10: pa.int64()}
        arrays = [pa.array(rows[:, i]).cast(wide.get(i, pa.int32())) for i in range(11)]
        for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32())):
            arrays.append(lists([v[i] for v in values], sizes, kind))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def units(words: Words, joined: str, stops: np.ndarray, ranks: np.ndarray, parts: np.ndarray) -> tuple[list, list, list]:
        rows, heads = _all_units(words, joined, window, stops)
        if not len(rows):
            return [], [], []
        document = (rows[:, 0] == WHOLE) & (rows[:, 1] == 0)
        own = rows[document, 6]
        # All first documents are in their filter, so one that is not there is a copy.
        copies = np.zeros(len(stops), dtype=bool)
        copies[own] = ~_passes(documents, _owner_keys(heads[document], ranks[own]))
        known = np.where(copies[rows[:, 6]], document, _passes(repeated, heads))
        rows, heads = rows[known], heads[known]
        plain = rows[:, 0] != ANCHOR
        anchors = rows[~plain, 1] + words.firsts[rows[~plain, 6]]
        rows, heads = rows[plain], heads[plain]
        own = rows[:, 6]
        # Units of one kind are in order of their texts, and so are equal ones after a stable sort.
        order = np.argsort(heads, kind="stable")
        before, after = order[:-1], order[1:]
        again = np.zeros(len(rows), dtype=np.int64)
        again[after] = (heads[after] == heads[before]) & (own[after] == own[before])
        out = np.empty((len(rows), 11), dtype=np.int64)
        out[:, 0], out[:, 1], out[:, 2], out[:, 3:5] = rows[:, 0], ranks[own], parts[own], rows[:, 1:3]
        out[:, 5], out[:, 6:8], out[:, 8], out[:, 9], out[:, 10] = rows[:, 5], rows[:, 3:5], again, heads, _second_halves(words, joined, rows)
        columns, sizes, values = [out], [np.zeros(len(out), dtype=np.int64)], []
        if len(anchors):
            bounds, heads, at, hashes = _windows(words, anchors, window)
            if len(heads):
                offsets = words.offsets[words.text[at]]
                starts, ends = words.starts[at] - offsets, words.ends[at + window - 1] - offsets
                first, last = bounds[:-1], bounds[1:] - 1
                own = words.text[at[first]]
                packs = np.empty((len(heads), 11), dtype=np.int64)
                packs[:, 0], packs[:, 1], packs[:, 2] = WINDOW, ranks[own], parts[own]
                packs[:, 3] = packs[:, 4] = at[first] - words.firsts[own]
                packs[:, 5], packs[:, 6], packs[:, 7], packs[:, 8], packs[:, 9] = window, starts[first], ends[last], 0, heads
                # The digest of a pack's list: a sum of its hashes, each mixed with its place.
                place = (np.arange(len(at)) - np.repeat(first, np.diff(bounds)) + 1).astype(np.uint64)
                mixed = _mixed(hashes.view(np.uint64) ^ _mixed(place))
                packs[:, 10] = np.add.reduceat(mixed, first).view(np.int64)
                columns.append(packs)
                sizes.append(np.diff(bounds))
                values.append((hashes, starts, ends))
        return columns, sizes, values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found, size = ([], [], []), 0
            ranks = batch.column(0).to_numpy()
            tied = _passes(shared, ranks)
            texts = batch.column(1).to_pylist()
            parts = np.zeros(len(ranks), dtype=np.int64)
            for i in tied.nonzero()[0].tolist():
                parts[i] = _part(texts[i] or "") or 1
            for begin, stop, joined, stops in _groups(texts):
                new = units(words, joined, stops, ranks[begin:stop], parts[begin:stop])
                for kept, more in zip(found, new, strict=True):
                    kept.extend(more)
                size += sum(map(len, new[0])) + sum(len(v[0]) for v in new[2])
                if size > 100_000:
                    yield flush(*found)
                    found, size = ([], [], []), 0
            yield flush(*found)

    return docs.select(_rank(doc_id), F.col(f"`{text}`")).mapInArrow(run, PACKED_ROWS)


UNIT_ROWS = "rank bigint, part bigint, pos int, start int, end int, words int, h1 bigint, h2 bigint"
UNIT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def find_units(docs: DataFrame, doc_id: str, text: str, unit: str) -> DataFrame:
    """(rank, part, pos, start, end, words, h1, h2): a row for each unit of each document.

    ``rank`` is the id, the last possible one where it is null; ``part`` tells texts apart that
    come under one id.
    """
    names = [x.split()[0] for x in UNIT_ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in names]
            for rank, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = _part(value or "")
                for pos, (start, end, words, digest) in enumerate(units_of(value or "", UNITS[unit])):
                    halves = np.frombuffer(digest, dtype="<i8").tolist()
                    for column, x in zip(columns, (rank, part, pos, start, end, words, *halves), strict=True):
                        column.append(x)
                    if len(columns[0]) >= 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, UNIT_TYPES, strict=True)], names=names)
                        columns = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, UNIT_TYPES, strict=True)], names=names)

    return docs.select(_rank(doc_id), F.col(f"`{text}`")).mapInArrow(run, UNIT_ROWS)


def _repeats_of(units: DataFrame) -> DataFrame:
    """``units`` with ``first``, their earliest place, without those that occur in one place only or first."""
    place = F.struct("rank", "part", "pos")
    first = (
        units.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("h1", "h2", "first")
    )
    # Written before the join, so that both of its sides are plain exchanges that skew can split.
    return units.join(cut(first), ["h1", "h2"]).filter(place != F.col("first"))


def repeated_passages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str | None = None,
    min_words: int = PASSAGE_WORDS,
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """(doc_id, part, start, end, n_words, n_units, kept_doc_id) of every passage to remove.

    Repeats are whole lines, paragraphs and documents of any length, runs of sentences of
    ``min_words`` words or more, and runs of ``window`` words or more wherever they begin and end;
    those that touch or overlap are one passage.  With a ``unit`` only its runs of ``min_words`` are.

    ``kept_doc_id`` is the document with the earliest occurrence of the passage's first unit.
    Occurrences are ranked by id, then by position; rows without an id come last.

    Nulls: null and empty texts have no units.  Rows that repeat an id and a text are one
    document; other texts under the same id are documents of their own, ordered by a hash.
    That hash is ``part``; without a ``unit`` it is 0 where the id has one row only.
    An empty table has no passages.
    """
    if unit is None:
        passages = _all_passages(docs, doc_id, text, min_words, window)
    else:
        found = _repeats_of(find_units(docs, doc_id, text, unit))
        rows = found.repartition("rank", "part").dropDuplicates(["rank", "part", "pos"])
        in_order = W.partitionBy("rank", "part").orderBy("pos")
        runs = rows.withColumn("_run", F.col("pos") - F.row_number().over(in_order))
        passages = runs.groupBy("rank", "part", "_run").agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("words").alias("n_words"),
            F.count(F.lit(1)).alias("n_units"),
            F.min_by("first.rank", "pos").alias("kept"),
        )
        passages = passages.filter(F.col("n_words") >= min_words)
    return passages.select(
        F.nullif("rank", F.lit(LAST_ID)).alias("doc_id"),
        "part",
        "start",
        "end",
        "n_words",
        "n_units",
        F.nullif("kept", F.lit(LAST_ID)).alias("kept_doc_id"),
    )


def _all_passages(docs: DataFrame, doc_id: str, text: str, min_words: int, window: int) -> DataFrame:
    """(rank, part, start, end, n_words, n_units, kept) of the passages of all kinds of units."""

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _owner_keys(*[c.to_numpy() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    counted = written(_counted(docs, doc_id, text, window))
    repeated = counted.filter(f"n % {DOCUMENT} > 1").select("h", "rank")
    documents = counted.filter(f"n >= {DOCUMENT}").select("h", "rank").mapInArrow(owners, "key bigint")
    shared = docs.select(_rank(doc_id).alias("key")).groupBy("key").count().filter("count > 1").select("key")
    filters = _filter_of(repeated.select("h")), _filter_of(documents), _filter_of(shared)
    units = written(_passing_units(docs, doc_id, text, window, *filters))
    rows = _single_repeats(units.filter(F.col("kind") != WINDOW), repeated)
    rows = rows.unionByName(_window_repeats(units.filter(F.col("kind") == WINDOW), window))
    return _joined(rows, min_words)


def _single_repeats(units: DataFrame, repeated: DataFrame) -> DataFrame:
    """The sentences and wholes that are not the first of their hash."""
    # Among several texts of the first rank, the one of the least part is first.
    tied = units.filter("part <> 0 AND NOT again").select("h1", "rank", "part").join(
        repeated.withColumnRenamed("h", "h1"), ["h1", "rank"]
    )
    tied = tied.groupBy("h1").agg(F.min("part").alias("first_part"))
    first = repeated.select(F.col("h").alias("h1"), F.col("rank").alias("kept")).join(tied, "h1", "left")
    first = written(first.withColumn("first_part", F.coalesce("first_part", F.lit(0))))
    later = (F.col("rank") != F.col("kept")) | (F.col("part") != F.col("first_part")) | F.col("again")
    # Numbers that do not compress stay out of the exchange.
    singles = units.select("kind", "rank", "part", "pos", "word", "words", "start", "end", "again", "h1")
    found = singles.join(first, "h1").filter(later)
    return found.select(
        "kind",
        "rank",
        "part",
        "pos",
        "word",
        "words",
        (F.col("word") + F.col("words")).alias("until"),
        "start",
        "end",
        F.lit(1).alias("n_units"),
        "kept",
    )


def _window_repeats(packs: DataFrame, window: int) -> DataFrame:
    """The windows that occur earlier, those that follow each other in a pack as one row."""
    lists = packs.groupBy("h1", "h2").agg(
        F.min(F.struct("rank", "part", "pos")).alias("first"),
        F.first("hashes").alias("hashes"),
        F.count(F.lit(1)).alias("n"),
    )
    lists = written(lists)
    several = lists.groupBy("h1").count().filter("count > 1").select("h1")
    mixed = lists.join(several, "h1", "left_semi").select("h1", "h2", "first", "n", F.posexplode("hashes").alias("i", "hash"))
    place = F.struct("first.rank", "first.part", (F.col("first.pos") + F.col("i")).alias("pos"))
    first = mixed.groupBy("h1", "hash").agg(F.min(place).alias("place"), F.sum("n").alias("n")).filter("n > 1")
    # Written before the join, so that both of its sides are plain exchanges that skew can split.
    each = mixed.select("h1", "h2", "i", "hash").join(written(first.select("h1", "hash", "place")), ["h1", "hash"])
    each = each.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("i", "place.*"))).alias("firsts"))
    alone = lists.filter("n > 1").join(several, "h1", "left_anti")
    known = alone.select("h1", "h2", "first", F.lit(None).cast(each.schema["firsts"].dataType).alias("firsts"))
    known = known.unionByName(each.withColumn("first", F.lit(None).cast(lists.schema["first"].dataType)))
    known = written(known)

    def apart(first: Column, pos: Column) -> Column:
        """A window that overlaps its own earliest occurrence is no repeat: the kept words would go too."""
        own = (F.col("rank") == first["rank"]) & (F.col("part") == first["part"])
        return ~own | (pos - first["pos"] >= window)

    found = packs.select("rank", "part", "pos", "h1", "h2", "starts", "ends").join(known, ["h1", "h2"])
    found = found.withColumn("hits", F.filter("firsts", lambda x: apart(x, F.col("pos") + x["i"])))
    hits = F.col("hits")
    begins = F.filter(hits, lambda x, k: (k == 0) | (F.get(hits, k - 1)["i"] != x["i"] - 1))
    ends = F.filter(hits, lambda x, k: (k == F.size(hits) - 1) | (F.get(hits, k + 1)["i"] != x["i"] + 1))
    spans = F.zip_with(begins, ends, lambda a, b: F.struct(a["i"].alias("a"), b["i"].alias("b"), a["rank"].alias("kept")))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.size("starts") - 1).alias("b"), F.col("first.rank").alias("kept")))
    spans = F.when(F.col("firsts").isNotNull(), spans).when(apart(F.col("first"), F.col("pos")), whole)
    found = found.select("rank", "part", "pos", "starts", "ends", F.explode(spans).alias("span"))
    return found.select(
        F.lit(WINDOW).alias("kind"),
        "rank",
        "part",
        (F.col("pos") + F.col("span.a")).alias("pos"),
        (F.col("pos") + F.col("span.a")).alias("word"),
        F.lit(window).alias("words"),
        (F.col("pos") + F.col("span.b") + window).alias("until"),
        F.get("starts", F.col("span.a")).alias("start"),
        F.get("ends", F.col("span.b")).alias("end"),
        (F.col("span.b") - F.col("span.a") + 1).alias("n_units"),
        F.col("span.kept").alias("kept"),
    )


def _joined(rows: DataFrame, min_words: int) -> DataFrame:
    """The passages of repeats that touch or overlap, by the positions of their words, in one exchange."""
    key = ["rank", "part"]
    rows = rows.repartition(*key).dropDuplicates([*key, "kind", "pos"])
    by_kind = W.partitionBy(*key, "kind").orderBy("pos")
    run = F.when(F.col("kind") == RUN, F.col("pos") - F.row_number().over(by_kind)).otherwise(F.col("pos"))
    units = rows.withColumn("_run", run).groupBy(*key, "kind", "_run").agg(
        F.min("word").alias("word"),
        F.sum("words").alias("words"),
        F.max("until").alias("until"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("n_units").alias("n_units"),
        F.min_by("kept", "pos").alias("kept"),
    )
    units = units.filter((F.col("kind") != RUN) | (F.col("words") >= min_words))
    units = units.withColumn("until", F.when(F.col("kind") == RUN, F.col("word") + F.col("words")).otherwise(F.col("until")))
    in_order = W.partitionBy(*key).orderBy("word", "words")
    before = F.max("until").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(F.col("word") > before, F.lit(True)).cast("int")
    numbered = units.withColumn("_begins", begins).withColumn(
        "_passage", F.sum("_begins").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    )
    return numbered.groupBy(*key, "_passage").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("until") - F.min("word")).cast("bigint").alias("n_words"),
        F.sum("n_units").alias("n_units"),
        F.min_by("kept", F.struct("word", "words")).alias("kept"),
    )


def remove_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text`` and ``removed``, the (start, end, kept_doc_id) cut from the original.

    A null text stays null; a document without passages keeps its text and has an empty list.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kept_doc_id", T.LongType())])
    added = T.StructType([T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(span))])
    by_doc = passages.groupBy(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("_rank"), F.col("part").alias("_part")
    ).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kept_doc_id"))).alias("_spans"))

    def part_of():
        def compute(texts: pa.Array) -> list:
            raw = texts.cast(pa.binary()).to_pylist()
            return [pa.array([None if not x else xxhash.xxh3_64_intdigest(x) >> 1 for x in raw], pa.int64())]

        return compute

    keyed = append_columns(docs, [text], T.StructType([T.StructField("_own_part", T.LongType())]), part_of)
    keyed = keyed.withColumn("_own_rank", F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LAST_ID)))
    # A part of 0 stands for the only text of its id.
    on = (F.col("_own_rank") == F.col("_rank")) & (F.col("_part").isin(0) | (F.col("_own_part") == F.col("_part")))
    joined = keyed.join(by_doc, on, "left").drop("_rank", "_part", "_own_rank", "_own_part")

    def make():
        def compute(texts: pa.Array, spans: pa.Array) -> list:
            kept, removed = [], []
            for value, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                at, pieces = 0, []
                for c in cuts or []:
                    pieces.append(value[at : c["start"]])
                    at = c["end"]
                kept.append(None if value is None else "".join(pieces) + value[at:])
                removed.append(cuts or [])
            return [kept, removed]

        return compute

    return append_columns(joined, [text, "_spans"], added, make).drop("_spans")
