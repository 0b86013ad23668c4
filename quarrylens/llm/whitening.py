"""Embedding whitening by the leading components of the covariance.

Entries become integers of a fixed step, so that sums are exact.  One pass adds up the sums of
every dimension, a second the products of centred entries; the covariance's leading eigenpairs
(``eigen``) form the projection, a small matrix that is sent to the tasks.  A third pass
measures the covariance of the whitened vectors.

Vectors of different lengths have nothing to compare: each length has its own counts, sums
and components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import append_columns
from quarrylens.llm.eigen import EPS, leading_eigenpairs
from quarrylens.operators.lineage import cut

COMPONENTS = 8
STEP, SHIFT = 1024, 100_000
MOST_ENTRY = float(1 << 33)
ROWS_AT_ONCE = 4096
MODEL_BYTES = 160 << 20  # of one pass's matrices; a single length is never split
MERGE_PARTS = 64

MOMENTS = "dims int, part int, i int, n bigint, moments array<double>"


class Centre(NamedTuple):
    """Mean of the integer vectors of one length: ``base`` and the rest of the sums over n."""

    n: int
    base: np.ndarray  # int64, the mean rounded
    rest: list[int]  # sums - n * base, at most n / 2 in size


class Model(NamedTuple):
    centre: Centre
    projection: np.ndarray  # dimensions x components; a column of NaN has no variance
    explained: np.ndarray


def usable(vector: str) -> Column:
    """A vector without nulls, not-a-numbers, infinities and entries beyond the integers' range."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(MOST_ENTRY)))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def integer_entries(vector: str, step: int, shift: int) -> Column:
    return F.transform(vector, lambda c: (F.floor(F.lit(float(step)) * c.cast("double")) + F.lit(shift)).cast("bigint"))


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integer matrix) of each length in an array, in parts of bounded size."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            some = rows[at : at + ROWS_AT_ONCE]
            yield int(length), some, vectors.take(pa.array(some)).flatten().to_numpy().reshape(len(some), -1)


def _sums(vectors: DataFrame) -> DataFrame:
    """(dims, at, n, total): exact sums of every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in _by_length(batch.column(0)):
                if length:
                    yield pa.RecordBatch.from_pydict(
                        {"dims": pa.array([length], pa.int32()), "n": pa.array([len(rows)]), "sums": pa.array([x.sum(axis=0).tolist()])}
                    )

    parts = vectors.mapInArrow(add, "dims int, n bigint, sums array<bigint>")
    each = parts.select("dims", "n", F.posexplode("sums").alias("at", "value"))
    return each.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))


def _centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    """Entries less their mean, to double precision: the integer part is exact."""
    return (x - centre.base) - np.array([r / centre.n for r in centre.rest])


def _merged(parts: DataFrame) -> DataFrame:
    """Moments (dims, i) added up in two steps, so that no group holds a row of every task."""

    def add(group: pa.Table) -> pa.Table:
        rows = np.stack([np.asarray(x, dtype=np.float64) for x in group.column("moments").to_pylist()])
        first = group.slice(0, 1)
        at = first.schema.get_field_index("moments")
        whole = first.set_column(at, "moments", pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64())))
        at = first.schema.get_field_index("n")
        return whole.set_column(at, "n", pa.array([int(np.sum(group.column("n").to_numpy()))], pa.int64()))

    for keys in (("dims", "i", "part"), ("dims", "i")):
        parts = parts.groupBy(*keys).applyInArrow(add, MOMENTS)
    return parts


def _products(vectors: DataFrame, centres: dict[int, Centre], rows_of) -> DataFrame:
    """Row ``i`` of the sum of products of ``rows_of(length, x)`` with themselves, per length."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        part = None
        for batch in batches:
            if batch.num_rows and part is None:
                part = int(batch.column(1)[0].as_py())
            for length, rows, x in _by_length(batch.column(0)):
                if length in centres:
                    y = rows_of(length, x)
                    found[length] = found.get(length, 0.0) + y.T @ y
                    counts[length] = counts.get(length, 0) + len(rows)
        for length, matrix in found.items():
            for i, row in enumerate(matrix):
                yield pa.RecordBatch.from_pydict(
                    {
                        "dims": pa.array([length], pa.int32()),
                        "part": pa.array([part], pa.int32()),
                        "i": pa.array([i], pa.int32()),
                        "n": pa.array([counts[length]], pa.int64()),
                        "moments": pa.array([row.tolist()], pa.list_(pa.float64())),
                    }
                )

    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)).cast("int")
    return _merged(vectors.select("_x", part.alias("_part")).mapInArrow(multiply, MOMENTS))


def _components(moments: DataFrame, count: int) -> DataFrame:
    """(dims, k, value, trace, vector) of every length's covariance, falling by value."""

    def solve(group: pa.Table) -> pa.Table:
        dims = group.column("dims")[0].as_py()
        order = np.argsort(group.column("i").to_numpy())
        rows = group.column("moments").to_pylist()
        matrix = np.array([rows[i] for i in order]) / group.column("n")[0].as_py()
        values, vectors = leading_eigenpairs((matrix + matrix.T) / 2, count)
        k = len(values)
        return pa.table(
            {
                "dims": pa.array([dims] * k, pa.int32()),
                "k": pa.array(range(k), pa.int32()),
                "value": pa.array(values),
                "trace": pa.array([float(np.trace(matrix))] * k),
                "vector": pa.array(vectors.tolist(), pa.list_(pa.float64())),
            }
        )

    return moments.groupBy("dims").applyInArrow(solve, "dims int, k int, value double, trace double, vector array<double>")


def _chunks(lengths: list[int]) -> Iterator[list[int]]:
    """Lengths whose matrices fit in one pass."""
    chunk, size = [], 0
    for length in sorted(lengths):
        if chunk and size + 8 * length * length > MODEL_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(length)
        size += 8 * length * length
    if chunk:
        yield chunk


def _centre(rows: list) -> Centre:
    n, totals = rows[0]["n"], [int(r["total"]) for r in sorted(rows, key=lambda r: r["at"])]
    base = [(2 * t + n) // (2 * n) for t in totals]
    return Centre(n, np.array(base, dtype=np.int64), [t - n * b for t, b in zip(totals, base, strict=True)])


def _model(centre: Centre, rows: list) -> Model:
    rows = sorted(rows, key=lambda r: r["k"])
    trace = rows[0]["trace"]
    # What rounding alone can give is no variance.
    least = len(centre.base) * EPS * trace
    scales = np.array([1 / np.sqrt(r["value"]) if r["value"] > least else np.nan for r in rows])
    explained = np.array([max(r["value"], 0.0) / trace if trace > 0 else np.nan for r in rows])
    return Model(centre, np.array([r["vector"] for r in rows]).T * scales, explained)


def _deviations(x: np.ndarray, centre: Centre) -> list[Decimal | None]:
    """Per row the sum of (n * x - sums) squared, exactly: n^2 uu - 2 n ur + rr for u = x - base."""
    u, n, r = x - centre.base, centre.n, centre.rest
    most = int(np.abs(u).max(initial=0))
    dims = u.shape[1]
    wide = most * max(most, n) * dims >= 1 << 62  # beyond long sums: with Python's integers
    u = u.astype(object) if wide else u
    rests = np.array(r, dtype=object if wide else np.int64)
    uu, ur, rr = (u * u).sum(axis=1).tolist(), (u * rests).sum(axis=1).tolist(), sum(a * a for a in r)
    found = [n * n * a - 2 * n * b + rr for a, b in zip(uu, ur, strict=True)]
    return [Decimal(v) if v < 10**38 else None for v in found]


def _filled(y: np.ndarray) -> list:
    """Rows as lists, null for not-a-number."""
    return [[None if v != v else v for v in row] for row in y.tolist()]


ADDED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
        T.StructField("explained", T.ArrayType(T.DoubleType())),
        T.StructField("identity_error", T.DoubleType()),
    ]
)


def whiten(
    vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS, step: int = STEP, shift: int = SHIFT
) -> DataFrame:
    """The usable rows of ``vectors`` with five columns added.

    An entry c counts as the integer ``floor(step * c) + shift``.  ``n`` is the number of usable
    vectors of the row's length, ``deviation`` the exact sum of (n * x - sum)^2 over the
    dimensions, ``whitened`` the centred row projected on each component over the root of its
    variance, ``explained`` each component's share of the variance, and ``identity_error`` the
    largest entry, by size, of the covariance of the whitened rows less the identity.

    Nulls: a vector that is null, empty, or holds a null, a not-a-number, an infinity or an
    entry of 2^33 or more goes; every other row stays, whatever its other columns hold, and
    repeated rows count as often as they occur.  A vector of fewer dimensions than
    ``components`` has as many components as dimensions.  A component without variance
    (equal vectors, too few of them) is null in ``whitened`` and left out of the error;
    without any variance ``explained`` is null too.  A deviation beyond 38 digits is null.  An
    empty table stays empty.  Input columns named like the added ones are replaced.
    """
    fine = vectors.filter(usable(f"`{embedding}`") & (F.size(f"`{embedding}`") > 0))
    entries = fine.select(integer_entries(f"`{embedding}`", step, shift).alias("_x"))
    sums = cut(_sums(entries))
    lengths = [r["dims"] for r in sums.select("dims").distinct().collect()]
    out = None
    for chunk in _chunks(lengths):
        some = sums.filter(F.col("dims").isin(chunk)).collect()
        centres = {d: _centre([r for r in some if r["dims"] == d]) for d in chunk}
        own = entries.filter(F.size("_x").isin(chunk))
        products = _products(own, centres, lambda d, x, c=centres: _centred(x, c[d]))
        # Written once: every task, also one that is run again, projects on the same components.
        found = cut(_components(products, components)).collect()
        models = {d: _model(centres[d], [r for r in found if r["dims"] == d]) for d in chunk}
        errors = _identity_errors(own, models)
        part = _project(fine.filter(F.size(f"`{embedding}`").isin(chunk)), embedding, models, errors, step, shift)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = _project(fine, embedding, {}, {}, step, shift)
    return out


def _identity_errors(entries: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per length the largest entry of the whitened rows' covariance less the identity."""

    def rows_of(length: int, x: np.ndarray) -> np.ndarray:
        model = models[length]
        live = model.projection[:, ~np.isnan(model.projection[0])]
        # A column of ones beside them, whose products are the count and the sums.
        return np.column_stack([_centred(x, model.centre) @ live, np.ones(len(x))])

    found: dict[int, dict[int, list[float]]] = {}
    for r in _products(entries, {d: m.centre for d, m in models.items()}, rows_of).collect():
        found.setdefault(r["dims"], {})[r["i"]] = r["moments"]
    errors = {}
    for length, rows in found.items():
        moments = np.array([rows[i] for i in sorted(rows)])
        n, means = moments[-1, -1], moments[:-1, -1] / moments[-1, -1]
        apart = moments[:-1, :-1] / n - np.outer(means, means) - np.eye(len(means))
        errors[length] = float(np.abs(apart).max(initial=0.0))
    return errors


def _project(rows: DataFrame, embedding: str, models: dict[int, Model], errors: dict[int, float], step: int, shift: int) -> DataFrame:
    placed = rows.withColumn("_whiten_x", integer_entries(f"`{embedding}`", step, shift))

    def make():
        def compute(vectors: pa.Array) -> list:
            total = len(vectors)
            counts, deviations, errs = [None] * total, [None] * total, [None] * total
            whitened, explained = [None] * total, [None] * total
            for length, at, x in _by_length(vectors):
                model = models[length]
                y = _filled(_centred(x, model.centre) @ model.projection)
                shares = _filled(model.explained[None, :])[0]
                for i, row, deviation in zip(at.tolist(), y, _deviations(x, model.centre), strict=True):
                    counts[i], deviations[i], errs[i] = model.centre.n, deviation, errors[length]
                    whitened[i], explained[i] = row, shares
            return [
                pa.array(counts, pa.int64()),
                pa.array(deviations, pa.decimal128(38, 0)),
                pa.array(whitened, pa.list_(pa.float64())),
                pa.array(explained, pa.list_(pa.float64())),
                pa.array(errs, pa.float64()),
            ]

        return compute

    return append_columns(placed, ["_whiten_x"], ADDED, make).drop("_whiten_x")
