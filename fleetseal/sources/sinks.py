"""Event delivery to files, partitioned by record type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseal.operators.findings import rendered


def deliver(events: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch of accepted events. The number belongs to the batch alone: written twice it leaves one copy.

    Files are packed: every record repeats its field names, in its text form once more.
    """
    (rendered(events).withColumn("event_type", F.col("record_type"))
     .write.mode("overwrite").partitionBy("event_type").json(f"{path}/batch_id={batch_id}", compression="gzip"))
