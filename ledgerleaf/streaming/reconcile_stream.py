"""Extension: the state of an inventory kept from a stream of changes, by the batch operators in foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each id by (changed_at, change_id)."""
    last = Window.partitionBy("id").orderBy(F.desc("changed_at"), F.desc("change_id"))
    return changes.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def apply_to(state_path: str, columns: list[str]):
    """A foreachBatch function that folds changes into the state, one version of it per batch, so a repeated batch is harmless."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest(batch).select("id", "deleted", *columns)
        if batch_id > 0:
            old = spark.read.parquet(f"{state_path}/{batch_id - 1}").join(new.select("id"), "id", "left_anti")
            new = old.unionByName(new.where("not deleted").select("id", *columns))
        else:
            new = new.where("not deleted").select("id", *columns)
        new.write.mode("overwrite").parquet(f"{state_path}/{batch_id}")

    return run
