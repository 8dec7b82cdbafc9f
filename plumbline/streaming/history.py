"""Optional extension: gate a stream of score observations against the last stored score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.gate import evaluate_gate


def gate_stream(observations: DataFrame, project_config: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Gate each micro-batch of (project, new_score) and append the decisions to the table at ``sink``.

    A batch goes to a folder of its own, so one that is done again after a
    failure replaces itself.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = evaluate_gate(batch.join(project_config.select("project", "last_score", "threshold"), "project"))
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return observations.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
