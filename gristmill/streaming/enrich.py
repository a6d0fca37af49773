"""Enrichment as a stream: rows join frozen vocabulary tables; no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import enrich
from ..sources.rules import Rules


def stream(rows: DataFrame, rules: Rules, vocabulary: enrich.Vocabulary, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes the cells of each micro-batch of catalogue rows to `path`, one folder a batch: a
    batch that is repeated after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        enrich.cells(enrich.enriched(batch, rules, vocabulary), rules).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
