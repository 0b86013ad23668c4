"""Helpers shared by the operators: Arrow row mapping, file bytes, sized broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.lineage import ensure_checkpoint_dir

TOKENIZERS = "/opt/tokenizers"
WHITE = "\t\n\x0b\x0c\r "  # the class [\x20\x09-\x0D]
BROADCAST_BYTES = 4 << 20
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that a result replaces, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def append_columns(
    df: DataFrame,
    needed: Sequence[str],
    added: T.StructType,
    make: Callable[[], Callable[..., list[pa.Array]]],
) -> DataFrame:
    """``df`` with the ``added`` columns, computed batch by batch in Arrow.

    ``make()`` runs once per task and returns a function of the ``needed`` columns (Arrow
    arrays) that gives one array per added field.  An input column with the name of an
    added one is replaced.
    """
    names = [f.name for f in added]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    inputs = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(needed)])
    width = len(kept)
    types = [_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            if compute is None:
                compute = make()
            # A batch has many rows, and long texts make it large: it is worked on in parts.
            step = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                columns = batch.slice(at, step).columns
                found = compute(*columns[width:])
                found = [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, t) for x, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:width], *found], names=[*kept, *names])

    fields = {f.name: f for f in df.schema}
    schema = T.StructType([fields[c] for c in kept] + list(added))
    return inputs.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver and sent with the task's function."""
    with open(path, "rb") as handle:
        return handle.read()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder, smaller there than its rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """``written`` (already on storage) marked for broadcast when its measured size is small.

    The size is the summed length of its rows as JSON, an upper bound of their binary form
    within a small factor.  Beyond the bound the join stays a shuffle join.
    """
    size = written.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(written) if size <= BROADCAST_BYTES else written
