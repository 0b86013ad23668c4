"""Which events a derived row was made from, as rows instead of lists.

The list of all event ids of a row is unbounded, so it is a relation:
(trace_id, layer, rowId, eventId), a projection of the facts without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import payload as p
from quarrylens.plans import facts as fx


def _numbered(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("rawIndex").cast("string"))


def _interaction_id() -> Column:
    args = F.col("args")
    number = p.v_num_text(args, "$.data.interactionId")
    kind = F.coalesce(p.v_text(args, "$.data.type"), F.lit("unknown"))
    loose = F.concat(kind, F.lit("@"), p.number_text(F.col("tsUs")))
    return F.when(
        (F.col("name") == "EventTiming") & p.v_object(args, "$.data").isNotNull(),
        F.when(number != "0", number).otherwise(loose),
    )


def _row_ids() -> dict[str, Column]:
    """Row id of each table as seen from one event; NULL when it plays no part."""
    event, name = F.col("eventId"), F.col("name")
    soft = p.v_id(F.col("args"), "$.context.softNavContextId")
    return {
        "devtools.facts.events": event,
        "devtools.facts.instantEvents": F.when(F.col("phase").isin(*fx.INSTANT_PHASES), event),
        "devtools.facts.sliceEvents": F.when(F.col("phase") == "X", event),
        "devtools.facts.asyncFlows": F.when(
            F.col("phase").isin(*fx.ASYNC_PHASES)
            | F.col("id").isNotNull()
            | F.col("flowScope").isNotNull(),
            event,
        ),
        "devtools.facts.objectLifecycles": F.coalesce("id", "flowScope"),
        "devtools.raw.events": event,
        "devtools.dims.processes": F.col("pid").cast("string"),
        "devtools.dims.threads": F.col("threadKey"),
        "devtools.dims.frames": F.col("frameId"),
        "devtools.dims.workers": F.col("workerId"),
        "devtools.dims.layers": F.col("layerId"),
        "devtools.dims.requests": F.col("requestId"),
        "devtools.dims.scripts": F.col("scriptId"),
        "devtools.dims.interactions": _interaction_id(),
        "devtools.dims.layoutShifts": F.when(name == "LayoutShift", _numbered("layout-shift:")),
        "devtools.dims.softNavigations": F.when(
            name.startswith("SoftNavigation"), F.coalesce(soft, _numbered("soft-nav:"))
        ),
        "devtools.views.renderMeasures": F.when(name == "UserTiming::Measure", _numbered("render:")),
        "devtools.views.framePipeline": F.when(
            name == "PipelineReporter", _numbered("frame-report:")
        ),
    }


def provenance(facts: DataFrame, layer: str) -> DataFrame:
    """(trace_id, layer, rowId, eventId) for the rows of one table."""
    ids = _row_ids()
    if layer not in ids:
        raise KeyError(f"No event provenance for: {layer}")
    return facts.select(
        "trace_id", F.lit(layer).alias("layer"), ids[layer].alias("rowId"), "eventId"
    ).filter(F.col("rowId").isNotNull())
