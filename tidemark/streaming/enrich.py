"""Enrich a stream of points: a stream-static left join, without state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.engine import Engine, Lookup


def enrich_stream(points: DataFrame, engine: Engine, lookups: list[Lookup], sink, trigger: dict | None = None, **options) -> StreamingQuery:
    """Run ``engine`` on each micro-batch of ``points`` and hand the result to ``sink(df, batch_id)``.

    ``trigger``: how often batches run, as of writeStream.trigger, such as
    {"availableNow": True}; by default each runs once the last is done. ``options`` go to
    the writer. Locations are distinct within a batch. Regions must be settled beforehand, else each
    batch would choose its own; an automatic region is refused.
    """
    if any(x.projected for x in lookups) and (engine.settings.auto is not None or engine.settings.partition):
        raise ValueError("a stream needs a named or explicit region")
    writer = points.writeStream.foreachBatch(lambda df, batch: sink(engine.run(df, *lookups), batch))
    for k, v in options.items():
        writer = writer.option(k, v)
    return (writer.trigger(**trigger) if trigger else writer).start()
