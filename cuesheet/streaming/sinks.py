"""Running a stream over what is available and reading its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuesheet.plans.session import shared_folder


def drain(stream: DataFrame, mode: str, name: str, per_batch=None) -> DataFrame:
    """Process all available input; each micro-batch becomes one folder of the result.

    A batch that is repeated after a failure overwrites its own folder, so every batch counts
    once. In update mode later batches supersede earlier rows; ``_batch`` tells them apart.
    """
    spark = stream.sparkSession
    target, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        result = per_batch(batch) if per_batch else batch
        result.write.mode("overwrite").parquet(f"{target}/_batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return spark.read.parquet(target)


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key from an update-mode result.

    A batch updates a key once, so a result of one batch is the last one as it is.
    """
    values = [c for c in updates.columns if c not in (*keys, "_batch")]
    batches = {path.rpartition("/_batch=")[2].partition("/")[0] for path in updates.inputFiles()}
    if len(batches) == 1:
        return updates.select(*keys, *values)
    picked = F.max_by(F.struct(*values), "_batch").alias("_row")
    return updates.groupBy(*keys).agg(picked).select(*keys, "_row.*")
