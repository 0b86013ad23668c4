"""Members of one large JSON array, read by many tasks.

A plain JSON file is cut into byte ranges anywhere.  What a range needs to know about the text
before it is whether it begins inside a string and how deep, and both follow from sums: each
range counts its quotes, and its brackets twice, once for either guess of how it begins.  A
running sum over the ranges of a file then settles all beginnings.  With them, ranges find the
arrays that are asked for, count the members that begin in them, and read those members, the
last one to its end beyond the range.  No task holds more than a block and one member.

A document that is an array has its items as members; in one that is an object, the members of
the arrays under one key are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut

SPLIT_BYTES = 16 << 20
TASK_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
BATCH_MEMBERS = 4096
BATCH_BYTES = 4 << 20
KEY_BYTES = 1 << 12

_SPACE = b" \t\n\r"
_KEY_BEFORE = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
_STEPS = np.zeros(256, dtype=np.int8)
_STEPS[[ord("["), ord("{")]] = 1
_STEPS[[ord("]"), ord("}")]] = -1
_MARKS = _STEPS != 0
_MARKS[ord(",")] = True


class State(NamedTuple):
    """How a range begins: inside a string, after an odd number of backslashes, and how deep."""

    inside: bool
    escaped: bool
    depth: int


class Bytes:
    """Random access to a file of known length."""

    def __init__(self, handle, length: int):
        self._handle = handle
        self.length = length

    def at(self, offset: int, size: int) -> bytes:
        self._handle.seek(offset)
        return self._handle.read(max(0, min(size, self.length - offset)))


def open_bytes(uri: str):
    """(file, length) of a plain file that Arrow's file systems can open."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    handle = system.open_input_file(path)
    return handle, handle.size()


def escaped_at(data: Bytes, offset: int) -> bool:
    """Whether an odd run of backslashes ends right before ``offset``."""
    run, size = 0, 64
    while offset - run > 0:
        low = max(0, offset - run - size)
        part = data.at(low, offset - run - low)
        own = len(part) - len(part.rstrip(b"\\"))
        run += own
        if own < len(part):
            break
        size *= 2
    return run % 2 == 1


def _quotes(block: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Places of the quotes that are not escaped, and whether the next byte is."""
    quotes = np.flatnonzero(block == 34)
    slashes = block == 92
    if not escaped and not slashes.any():
        return quotes, False
    places = np.arange(len(block), dtype=np.int32)
    last = np.maximum.accumulate(np.where(slashes, np.int32(-1), places))
    before = np.where(quotes > 0, last[quotes - 1], -1)
    runs = quotes - 1 - before + np.where(before < 0, int(escaped), 0)
    tail = len(block) - 1 - int(last[-1]) + (int(escaped) if last[-1] < 0 else 0)
    return quotes[runs % 2 == 0], tail % 2 == 1


def _marks(block: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, np.ndarray, State]:
    """Places, bytes and depths after them of the brackets and commas outside strings."""
    quotes, escaped = _quotes(block, state.escaped)
    places = np.flatnonzero(_MARKS[block])
    outside = (np.searchsorted(quotes, places) + state.inside) % 2 == 0
    places = places[outside]
    found = block[places]
    depths = state.depth + np.cumsum(_STEPS[found], dtype=np.int64)
    after = State((state.inside + len(quotes)) % 2 == 1, escaped, int(depths[-1]) if len(depths) else state.depth)
    return places, found, depths, after


def _blocks(data: Bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    for at in range(start, end, BLOCK_BYTES):
        yield at, data.at(at, min(BLOCK_BYTES, end - at))


def summary(data: Bytes, start: int, end: int) -> tuple[int, int, int]:
    """(quotes, change of depth if the range begins outside a string, change if inside)."""
    escaped, count, changes = escaped_at(data, start), 0, [0, 0]
    for _, raw in _blocks(data, start, end):
        block = np.frombuffer(raw, dtype=np.uint8)
        quotes, escaped = _quotes(block, escaped)
        places = np.flatnonzero(_STEPS[block])
        odd = (np.searchsorted(quotes, places) + count) % 2
        steps = _STEPS[block[places]].astype(np.int64)
        changes[0] += int(steps[odd == 0].sum())
        changes[1] += int(steps[odd == 1].sum())
        count += len(quotes)
    return count, *changes


def root_of(data: Bytes) -> tuple[str, int]:
    """The first character of the document and its place; empty for a blank file."""
    for at, raw in _blocks(data, 0, data.length):
        rest = raw.lstrip(_SPACE)
        if rest:
            return chr(rest[0]), at + len(raw) - len(rest)
    return "", 0


def key_before(data: Bytes, offset: int) -> bytes | None:
    """The raw name of the member whose value begins at ``offset``."""
    size = KEY_BYTES
    while True:
        low = max(0, offset - size)
        found = _KEY_BEFORE.search(data.at(low, offset - low))
        if found:
            return found.group(1)
        if low == 0:
            return None
        size *= 4


def array_ends(data: Bytes, start: int, end: int, state: State, key: str | None) -> Iterator[tuple[int, int]]:
    """(place, +1 or -1) of the beginnings and ends, in this range, of the arrays to read."""
    root, _ = root_of(data)
    level = 1 if root == "[" else 2
    wanted = None if key is None else key.encode()
    for at, raw in _blocks(data, start, end):
        places, found, depths, state = _marks(np.frombuffer(raw, dtype=np.uint8), state)
        opens = (found == ord("[")) & (depths == level)
        closes = (found == ord("]")) & (depths == level - 1)
        for i in np.flatnonzero(opens | closes).tolist():
            place = at + int(places[i])
            if closes[i]:
                yield place, -1
            elif root == "[" or (root == "{" and wanted is not None and key_before(data, place) == wanted):
                yield place, 1


def members(data: Bytes, start: int, end: int, state: State, arrays: Sequence[tuple[int, int]]) -> Iterator[bytes]:
    """The members that begin in the range, whole; ``arrays`` are (place of [, place of ])."""
    arrays = [a for a in arrays if a[1] >= start and a[0] < end]
    if not arrays:
        return
    begins, ends = {a for a, _ in arrays}, {b for _, b in arrays}
    root, _ = root_of(data)
    level = 1 if root == "[" else 2
    lows, highs = (np.array(sorted(x), dtype=np.int64) for x in (begins, ends))
    open_: list[bytes] | None = None
    at = start
    while at < data.length and (at < end or open_ is not None):
        raw = data.at(at, BLOCK_BYTES if at >= end else min(BLOCK_BYTES, end - at))
        places, found, depths, state = _marks(np.frombuffer(raw, dtype=np.uint8), state)
        # A comma of the level belongs to an array to read if it lies between its ends.
        cuts = np.flatnonzero(((found == ord(",")) & (depths == level)) | ((found == ord("[")) & (depths == level)) | ((found == ord("]")) & (depths == level - 1)))
        last = 0
        for i, offset in zip(cuts.tolist(), (at + places[cuts]).tolist(), strict=True):
            mark = found[i]
            within = int(np.searchsorted(lows, offset, side="right"))
            if mark == ord(","):
                if not within or offset > highs[within - 1]:
                    continue
            elif offset not in (begins if mark == ord("[") else ends):
                continue
            if open_ is not None:
                text = b"".join([*open_, raw[last : offset - at]]).strip(_SPACE)
                if text:
                    yield text
                open_ = None
            if mark != ord("]"):
                if offset >= end:
                    return
                open_, last = [], offset - at + 1
        if open_ is not None:
            open_.append(raw[last:])
        at += len(raw)


def skeleton(data: Bytes, arrays: Sequence[tuple[int, int]]) -> bytes:
    """The document with the arrays that are read elsewhere left empty."""
    parts, at = [], 0
    for begin, end in sorted(arrays):
        parts.append(data.at(at, begin + 1 - at))
        at = end
    return b"".join([*parts, data.at(at, data.length - at)])


# Over Spark -----------------------------------------------------------------------------
def _over_files(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(bytes, row)`` yields tuples for every row (trace_id, uri, ...); files stay open within a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            uri = handle = None
            out: list[tuple] = []
            size = 0
            for row in batch.to_dict("records"):
                if row["uri"] != uri:
                    if handle is not None:
                        handle.close()
                    uri = row["uri"]
                    handle, length = open_bytes(uri)
                for found in work(Bytes(handle, length), row):
                    out.append((row["trace_id"], *found))
                    size += len(found[-1]) if isinstance(found[-1], str) else 16
                    if len(out) >= BATCH_MEMBERS or size >= BATCH_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
            if handle is not None:
                handle.close()
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def _state(row: dict, data: Bytes) -> State:
    return State(bool(row["inside"]), escaped_at(data, row["at"]), int(row["depth"]))


def _spread(rows: DataFrame, tasks: int) -> DataFrame:
    """Ranges over tasks, those of a file one after the other, so that it is opened once."""
    return rows.repartition(tasks).sortWithinPartitions("uri", "at")


def range_tasks(spark: SparkSession, count: int, split_bytes: int) -> int:
    """Tasks for so many ranges: as many as there is work for, since a short range costs less than a task."""
    return max(1, min(count, max(4 * spark.sparkContext.defaultParallelism, count * split_bytes // TASK_BYTES)))


def split_files(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, int]:
    """(trace_id, uri, at, stop) of byte ranges of (trace_id, uri, length), and their number."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    splits = files.select("trace_id", "uri", "length", starts.alias("at")).withColumn("stop", F.least(F.col("at") + split_bytes, "length"))
    splits = cut(splits.drop("length"))
    return splits, splits.count()


def read_members(files: DataFrame, key: str | None, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(trace_id, position, text) of array members, and (trace_id, skeleton) of the rest of each document.

    ``files`` holds (trace_id, uri, length) of plain files.  Members are counted through all
    arrays of ``key``.  The skeleton is null for a document whose brackets or strings do not
    close, or that is neither an array nor an object; such a document may have members all the same.
    """
    splits, count = split_files(files, split_bytes)
    tasks = range_tasks(files.sparkSession, count, split_bytes)
    sums = cut(
        _over_files(
            _spread(splits, tasks),
            lambda data, r: [(r["at"], *summary(data, r["at"], r["stop"]))],
            "trace_id string, at bigint, quotes bigint, if_outside bigint, if_inside bigint",
        )
    )
    # One row per range: the window holds a file's ranges, not its text.
    before = Window.partitionBy("trace_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    settled = sums.withColumn("inside", odd).withColumn("step", F.when(F.col("inside"), F.col("if_inside")).otherwise(F.col("if_outside")))
    settled = settled.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    begun = cut(splits.join(settled.select("trace_id", "at", "inside", "depth", "step", "quotes"), ["trace_id", "at"]))
    closed = begun.groupBy("trace_id").agg(((F.sum("step") == 0) & (F.sum("quotes") % 2 == 0)).alias("closed"))

    marks = _over_files(
        _spread(begun, tasks),
        lambda data, r: array_ends(data, r["at"], r["stop"], _state(r, data), key),
        "trace_id string, place bigint, way int",
    )
    in_order = Window.partitionBy("trace_id").orderBy("place")
    paired = marks.withColumn("stop", F.lead("place").over(in_order)).withColumn("next", F.lead("way").over(in_order))
    ranges = paired.filter((F.col("way") == 1) & (F.col("next") == -1)).groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("place", "stop"))).alias("arrays"))
    ranges = cut(ranges)
    placed = cut(begun.join(ranges, "trace_id"))

    def arrays_of(row: dict) -> list[tuple[int, int]]:
        return [(a["place"], a["stop"]) for a in row["arrays"]]

    def found(data: Bytes, row: dict) -> Iterator[bytes]:
        return members(data, row["at"], row["stop"], _state(row, data), arrays_of(row))

    counted = _over_files(
        _spread(placed, tasks), lambda data, r: [(r["at"], sum(1 for _ in found(data, r)))], "trace_id string, at bigint, n bigint"
    )
    first = cut(counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("trace_id", "at", "first"))
    rows = _over_files(
        _spread(placed.join(first, ["trace_id", "at"]), tasks),
        lambda data, r: ((r["first"] + i, text.decode("utf-8", "replace")) for i, text in enumerate(found(data, r))),
        "trace_id string, position bigint, text string",
    )

    def rest(data: Bytes, row: dict) -> Iterator[tuple[str | None]]:
        root, _ = root_of(data)
        sound = row["closed"] and root in ("[", "{")
        yield (skeleton(data, arrays_of(row) if row["arrays"] is not None else []).decode("utf-8", "replace") if sound else None,)

    whole = files.join(closed, "trace_id").join(ranges, "trace_id", "left")
    return rows, _over_files(whole, rest, "trace_id string, skeleton string")
