"""Line dedup over levelled sorted runs of line keys.

A run is a bucketed table of (h1, h2, holder): line keys as 128-bit hashes, sorted by them
inside hash buckets, and the smallest document that holds the line.  A new batch of
documents is merge-joined with the runs (an anti join for the keys that are new, a semi join
for the lines that are not), and its own new keys become a run of level 0.  When a level has
``FAN_OUT`` runs, they are merged into one run of the next level, so a store of n batches
keeps about log(n) runs and every key is rewritten about log(n) times.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import WHITE, append_columns
from quarrylens.operators.lineage import cut

LEAST_POINTS = 10
FAN_OUT = 4
KEY = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    """The line without outer white space, A-Z in lower case."""
    return line.strip(WHITE.encode()).lower()


def long_enough(key: bytes) -> bool:
    """Whether a UTF-8 key has ``LEAST_POINTS`` code points."""
    return len(key) >= LEAST_POINTS and (len(key) >= 4 * LEAST_POINTS or len(key.decode()) >= LEAST_POINTS)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and different key: (doc_id, h1, h2)."""
    for batch in batches:
        ids, digests = [], []
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            if text:
                found = {key_hash(k) for k in set(map(line_key, text.split(b"\n"))) if long_enough(k)}
                digests.extend(found)
                ids.extend([doc_id] * len(found))
            if len(ids) > 200_000:
                yield _key_batch(ids, digests)
                ids, digests = [], []
        yield _key_batch(ids, digests)


def _key_batch(ids: list, digests: list[bytes]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", *KEY]
    )


class LineRuns:
    """The runs of one store: bucketed tables in the session's catalog and warehouse.

    The number of buckets is fixed when the store is made and should follow the data it will
    hold; a bucket is sorted, so a join with a batch reads it once, in order.
    """

    def __init__(self, spark: SparkSession, buckets: int, name: str | None = None, fan_out: int = FAN_OUT):
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.name = name or f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made = 0

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, keys: DataFrame) -> str:
        run = f"{self.name}_{self.made}"
        self.made += 1
        (
            keys.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .format("parquet")
            .saveAsTable(run)
        )
        return run

    def holders(self) -> DataFrame | None:
        """All keys with their first holder; the runs have no key in common."""
        found = None
        for run in self.runs():
            rows = self.spark.table(run)
            found = rows if found is None else found.unionByName(rows)
        return found

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch of (doc_id, h1, h2); return its (h1, h2, holder) that lose lines.

        The documents of a batch come after those of earlier batches.  A key of the runs loses
        its lines in the whole batch; a new key keeps them in the batch's smallest document.
        The batch is reduced to one row per key before it meets the runs, so a line that many
        documents hold is one row there.
        """
        keys = cut(batch.groupBy(*KEY).agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last")))
        fresh, old = keys, None
        for run in self.runs():
            rows = self.spark.table(run)
            known = keys.join(rows.select(*KEY, F.col("holder").alias("before")).hint("merge"), KEY)
            known = known.select(*KEY, F.col("before").alias("holder"))
            old = known if old is None else old.unionByName(known)
            fresh = fresh.join(rows.select(*KEY).hint("merge"), KEY, "left_anti")
        fresh = cut(fresh) if old is not None else fresh
        shared = fresh.filter("holder < last").select(*KEY, "holder")
        losing = cut(shared if old is None else shared.unionByName(old))
        self._push(0, self._write(fresh.select(*KEY, "holder")))
        return losing

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def compact(self) -> None:
        """Merge every full level into one run of the next and drop the merged tables."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_out:
                full = self.levels[level]
                merged = None
                for run in full:
                    rows = self.spark.table(run)
                    merged = rows if merged is None else merged.unionByName(rows)
                self._push(level + 1, self._write(merged))
                self.levels[level] = []
                for run in full:
                    self.spark.sql(f"DROP TABLE {run}")
            level += 1

    def drop(self) -> None:
        for run in self.runs():
            self.spark.sql(f"DROP TABLE {run}")
        self.levels = []


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h1, h2): the different line keys of each document that are long enough."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_line_keys, "doc_id bigint, h1 bigint, h2 bigint")


def drop_lines(text: bytes | None, dropped: set[bytes]) -> tuple[bytes, int, int]:
    """The text without the lines of the dropped keys, its lines before, and those dropped."""
    lines = (text or b"").split(b"\n")
    if not dropped:
        return text or b"", len(lines), 0
    kept = []
    for line in lines:
        key = line_key(line)
        if not (long_enough(key) and key_hash(key) in dropped):
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    batches: int = 4,
    runs: LineRuns | None = None,
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``; an own ``runs`` is kept for later calls.

    The documents enter in ``batches`` ranges of rising ids, as they would arrive over time.

    Nulls: a null text is one empty line; rows without an id come last and count as one
    document.  Rows of one id are one document: its lines are compared with other ids only.
    Empty texts and tables pass through.  An input column named like a result is replaced.
    """
    spark = docs.sparkSession
    store = runs or LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(2**63 - 1))
    ids = docs.select(number.alias("_id"))
    shares = [i / batches for i in range(1, batches)]
    cuts = ids.filter(f"_id < {2**63 - 1}").approxQuantile("_id", shares, 0.01) if shares else []
    edges = [None, *sorted({int(x) for x in cuts}), None]
    losses = None
    for low, high in zip(edges, edges[1:]):
        part = docs.select(number.alias("doc_id"), F.col(f"`{text}`").alias("text"))
        part = part if low is None else part.filter(F.col("doc_id") > low)
        part = part if high is None else part.filter(F.col("doc_id") <= high)
        pairs = cut(line_keys(part))
        losing = store.add(pairs)
        store.compact()
        lost = pairs.join(losing, KEY).filter("doc_id > holder").select("doc_id", *KEY)
        losses = lost if losses is None else losses.unionByName(lost)
    if runs is None:
        store.drop()
    by_doc = losses.groupBy(F.col("doc_id").alias("_lost_id")).agg(
        F.collect_list(F.struct(*KEY)).alias("_lost")
    )
    joined = docs.withColumn("_id", number).join(by_doc, F.col("_id") == F.col("_lost_id"), "left").drop("_id", "_lost_id")
    added = T.StructType(
        [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )

    def make():
        def compute(texts: pa.Array, lost: pa.Array) -> list:
            halves = np.stack([lost.flatten().field(0).to_numpy(), lost.flatten().field(1).to_numpy()], axis=1)
            raw = np.ascontiguousarray(halves, dtype="<i8").tobytes()
            sizes = np.nan_to_num(np.array(pc.list_value_length(lost).to_numpy(zero_copy_only=False), dtype=float))
            ends = np.cumsum(sizes).astype(np.int64).tolist()
            rows, at = [], 0
            for value, end in zip(texts.cast(pa.binary()).to_pylist(), ends, strict=True):
                dropped = {raw[16 * i : 16 * i + 16] for i in range(at, end)}
                rows.append(drop_lines(value, dropped))
                at = end
            kept = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
            return [kept, [r[1] for r in rows], [r[2] for r in rows]]

        return compute

    return append_columns(joined, [text, "_lost"], added, make).drop("_lost")
