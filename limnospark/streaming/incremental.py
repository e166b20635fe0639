"""foreachBatch adapter: batch operator per micro-batch, one folder a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def append_each_batch(stream: DataFrame, op: Callable[[DataFrame], DataFrame], out_path: str, name: str,
                      trigger_once: bool = True):
    """Start a streaming query that applies ``op`` to each micro-batch and
    writes the result into the partition ``batch_id=<id>`` of the Parquet
    table at ``out_path``. A batch that is run again overwrites its own
    partition, so its rows are there once."""
    ckpt = ensure_checkpoint_dir(stream.sparkSession).rstrip("/") + f"/streams/{name}"

    def run(batch: DataFrame, batch_id: int) -> None:
        op(batch).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
