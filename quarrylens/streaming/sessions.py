"""Sessions of a stream, split by a quiet gap and capped in length.

The rows of a key wait in its state until the watermark has passed them, so that they are taken
in order of time.  Then they join the open session or begin the next one; a session is given when a
row begins another, or when the watermark shows that none can join it any more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "open_start bigint, open_last bigint, open_sums array<double>, waiting array<struct<ts: bigint, sums: array<double>>>"


def fold(open_: tuple | None, rows: list[tuple], gap: int, max_span: int) -> tuple[tuple | None, list[tuple]]:
    """Take (ts, sums) rows in order of time; (the open session, the closed ones) as (start, last, sums)."""
    closed = []
    for ts, sums in sorted(rows):
        if open_ is not None and (ts - open_[1] > gap or ts - open_[0] > max_span):
            closed.append(open_)
            open_ = None
        if open_ is None:
            open_ = (ts, ts, list(sums))
        else:
            open_ = (open_[0], ts, [a + b for a, b in zip(open_[2], sums, strict=True)])
    return open_, closed


def capped_sessions_stream(
    df: DataFrame, keys: Sequence[str], ts: str, gap: int, max_span: int, sums: Sequence[str], delay: str = "1 minute"
) -> DataFrame:
    """One row per session: keys, ``start_ts``, ``last_ts`` and the sums as doubles, for append mode.

    Times are whole microseconds.  Sessions equal those of the batch operator for all rows that
    come before the watermark; later ones are left out.  A key's state holds the rows of ``delay``.
    """
    keys, sums = list(keys), list(sums)
    at = F.timestamp_micros(F.col(ts))
    rows = df.select(*keys, F.col(ts).cast("bigint").alias("_ts"), *[F.col(s).cast("double").alias(s) for s in sums], at.alias("_at"))
    fields = [f for f in df.schema if f.name in keys]
    out = T.StructType(
        [
            *[next(f for f in fields if f.name == k) for k in keys],
            T.StructField("start_ts", T.LongType()),
            T.StructField("last_ts", T.LongType()),
            *[T.StructField(s, T.DoubleType()) for s in sums],
        ]
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, waiting = None, []
        if state.exists:
            start, last, own, held = state.get
            open_ = None if start is None else (start, last, list(own))
            waiting = [(r["ts"], list(r["sums"])) if isinstance(r, dict) else (r[0], list(r[1])) for r in held]
        for batch in batches:
            waiting += [(int(r[0]), [float(x) for x in r[1:]]) for r in batch[["_ts", *sums]].itertuples(index=False)]
        mark = state.getCurrentWatermarkMs() * 1000
        ready = [r for r in waiting if r[0] < mark]
        waiting = [r for r in waiting if r[0] >= mark]
        open_, closed = fold(open_, ready, gap, max_span)
        if open_ is not None and mark - open_[1] > gap:
            closed.append(open_)
            open_ = None
        if open_ is None and not waiting:
            state.remove()
        else:
            state.update((*(open_ or (None, None, None)), [{"ts": t, "sums": s} for t, s in waiting]))
            # Next to look at: the first row that waits, or the end of the open session's gap.
            wake = min([t for t, _ in waiting] + ([open_[1] + gap] if open_ is not None else []))
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame([(*key, s, e, *own) for s, e, own in closed], columns=out.fieldNames())

    return (
        rows.withWatermark("_at", delay)
        .groupBy(*keys)
        .applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
