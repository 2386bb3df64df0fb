"""Coverage over streams: valid rows' hits accumulate; state is one count for each target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import hit_columns
from ..operators.predicates import _all, row_rules


def hits_stream(rows: DataFrame, schema, only_valid: bool = True, time: str | None = None, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Running counts of hits by target of a streaming (or plain) DataFrame: id, n.

    An invalid row commits nothing. With a time column counts are by window and late rows beyond the watermark drop out.
    """
    found = hit_columns(rows, schema)
    valid = _all([r.passes for r in row_rules(rows, schema)]) if only_valid else F.lit(True)
    if time:
        rows = rows.withWatermark(time, watermark)
    ids = F.array_compact(F.array(*[F.when(c, F.lit(t["id"])) for t, c in found]))
    keys = [F.window(time, window).alias("window")] if time else []
    events = rows.where(valid).select(*([time] if time else []), F.explode(ids).alias("id"))
    return events.groupBy(*keys, "id").agg(F.count("*").alias("n"))
