"""Position streams snapped to the graph, one micro-batch at a time.

Each batch is answered by the same spatial join as a table; the graph is read
once per batch. A batch that is replayed after a failure writes the same rows to
the same folder (``batch=<id>``), so the sink holds every position once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from railspoke.operators.graph import nearest


def snap_positions(
    positions: DataFrame, nodes: DataFrame, key: str, sink: str, checkpoint: str, radii: tuple[float, ...] = (100.0, 500.0, 2000.0)
) -> StreamingQuery:
    """Writes (key, osmid, distance_m, rank) of each position's nearest node to Parquet under ``sink``; positions off the graph (past the last radius) get none."""

    def batch(rows: DataFrame, number: int) -> None:
        nearest(rows, nodes, key, 1, radii, beyond=False).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return positions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
