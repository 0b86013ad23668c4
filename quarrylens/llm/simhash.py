"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint takes the majority of each bit over the hashes of its word shingles.
Two fingerprints of 64 bits are linked at ``BUDGET`` or fewer differing bits.  The bits are
cut into ``SEGMENTS`` on a ring.  If all differences together stay within the budget, then
some segment starts a chain in which every run of l consecutive segments has at most
l * BUDGET / SEGMENTS differences, for all l (the pigeonring principle).  With five segments
and four bits: 0 in the first, 1 in the first two, then 2, 3 and 4.

The first two conditions make the index: the first segment is equal, and of the second's two
halves one is equal.  That gives ten keys of about 19 bits per fingerprint.  Pairs that share
a key are pruned by the chain's further conditions and only then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import append_columns
from quarrylens.llm.graph import components
from quarrylens.llm.units import Forest, near_pairs, to_units, whole_units
from quarrylens.operators.lineage import cut

SHINGLE_WORDS = 4
SEED = 42
BITS = 64
BUDGET = 4
SEGMENTS = 5
BITS_AT_ONCE = 4096


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, A-Z in lower case, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    count = len(words) - size + 1
    if count <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=count)


def fingerprint(text: bytes | None) -> int:
    """The bits set in over half of the hashes; zero for a text without words."""
    hashes = shingle_hashes(text or b"")
    if not len(hashes):
        return 0
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[at : at + BITS_AT_ONCE].astype("<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed 64-bit number."""

    def make():
        def compute(texts: pa.Array) -> list:
            found = [fingerprint(x) for x in texts.cast(pa.binary()).to_pylist()]
            return [pa.array(np.array(found, dtype=np.uint64).view(np.int64))]

        return compute

    return append_columns(docs, [text], T.StructType([T.StructField("fp", T.LongType())]), make)


def segment_edges(segments: int = SEGMENTS) -> list[int]:
    return [round(i * BITS / segments) for i in range(segments + 1)]


def _mask(low: int, high: int) -> int:
    return (1 << high) - (1 << low)


def chain_masks(segments: int = SEGMENTS) -> np.ndarray:
    """[start, length - 1]: the bits of each chain of consecutive segments on the ring."""
    edges = segment_edges(segments)
    one = [_mask(a, b) for a, b in zip(edges, edges[1:])]
    masks = np.zeros((segments, segments), dtype=np.uint64)
    for start in range(segments):
        bits = 0
        for length in range(segments):
            bits |= one[(start + length) % segments]
            masks[start, length] = bits
    return masks


def index_keys(fp: str = "fp", segments: int = SEGMENTS):
    """The ten keys of a fingerprint: (start, half, first segment, half of the second)."""
    edges = segment_edges(segments)

    def bits(low: int, high: int):
        return F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << (high - low)) - 1))

    keys = []
    for start in range(segments):
        first = bits(edges[start], edges[start + 1])
        low, high = edges[(start + 1) % segments], edges[(start + 1) % segments + 1]
        middle = (low + high) // 2
        for half, part in enumerate((bits(low, middle), bits(middle, high))):
            head = F.lit((2 * start + half) << 32)
            keys.append(head + F.shiftleft(first, 16) + part)
    return F.array(*keys)


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray, masks: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Positions of the pairs that keep the chain's budgets from their start and the whole budget."""
    differ = a ^ b
    segments = masks.shape[1]
    at = np.arange(len(differ))
    for length in range(1, segments):
        allowed = (length + 1) * budget // segments
        ok = np.bitwise_count(differ[at] & masks[start[at], length]) <= allowed
        at = at[ok]
    return at


def links(prints: DataFrame, fp: str = "fp", node: str = "node") -> DataFrame:
    """(a, b): for different fingerprints, links that connect the same nodes as all links do.

    Within a unit the links found are reduced to a spanning forest, so a group of thousands
    of similar fingerprints gives as many rows, not their pairs.
    """
    masks = chain_masks()
    rows = prints.select(F.explode(index_keys(fp)).alias("key"), F.col(fp).alias("fp"), F.col(node).alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_units(batches, "key"):
            prints = table.column("fp").to_numpy().view(np.uint64)
            nodes = table.column("node").to_numpy()
            side, crossing = table.column("side").to_numpy(), table.column("ua").to_numpy() != table.column("ub").to_numpy()
            ring = (table.column("key").to_numpy() >> 33).astype(np.int64)
            forest = Forest(len(prints))
            for i, j in near_pairs(starts, side, crossing):
                hit = linked(prints[i], prints[j], ring[i], masks)
                forest.join(i[hit], j[hit])
            roots = forest.roots()
            moved = np.flatnonzero(roots != np.arange(len(roots)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], names=["a", "b"])

    return to_units(rows, "key", "node").mapInArrow(run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` with an id.

    Texts of one fingerprint are one class, whatever its size; only the classes are compared.
    Nulls: a null text has fingerprint zero, as a text without words; rows without an id are
    left out.  Repeated rows come back as often as they are given.  An empty table gives none.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = cut(with_fingerprint(rows.filter("doc_id is not null")).select("doc_id", "fp"))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(classes))
    named = cut(
        classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    )
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, for each group of near copies.

    Rows without an id stay.  Of rows that repeat the id and the text of a kept document one
    stays; another text under that id is a document of its own and stays too.
    """
    kept = simhash_groups(docs, doc_id, text).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    own = F.col(f"`{doc_id}`")
    named = docs.filter(own.isNotNull()).join(kept, own == F.col("_kept"), "left_semi")
    named = named.withColumn("_digest", F.md5(F.col(f"`{text}`"))).dropDuplicates([doc_id, "_digest"]).drop("_digest")
    return named.unionByName(docs.filter(own.isNull()))
