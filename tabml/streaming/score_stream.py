"""Live scoring as a Structured Streaming query.

Scoring is stateless (no aggregation, no state), so there is no watermark.
Two ways to run it:

* ``score_stream``: the scored stream itself, for pipelines whose stages are
  pure projections (scaling, selection, one-hot, trees, linear models...).
* ``score_stream_batches``: ``foreachBatch``; each micro-batch is scored as a
  static DataFrame.  Needed when a stage runs its own jobs (the KNN imputer
  and KNN models join each batch with the stored training rows).  Writes are
  keyed by the epoch id, so a replayed batch overwrites its own output
  (exactly-once to the sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.score import ScoringBundle, score

BATCH_ONLY_STAGES = ("KnnImputerModel", "KNeighborsModel")


def needs_batches(bundle: ScoringBundle) -> bool:
    return any(type(s).__name__ in BATCH_ONLY_STAGES for s in bundle.pipeline.stages)


def score_stream(bundle: ScoringBundle, stream: DataFrame, passthrough=()) -> DataFrame:
    """Return the scored streaming DataFrame (call ``writeStream`` on it)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    if needs_batches(bundle):
        raise ValueError("this pipeline joins with its training rows; use score_stream_batches")
    return score(bundle, stream, passthrough=passthrough)


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def score_files(spark: SparkSession, bundle: ScoringBundle, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int = 1, passthrough=()) -> DataFrame:
    return score_stream(bundle, file_stream(spark, path, schema, fmt, max_files_per_trigger), passthrough)


def score_stream_batches(bundle: ScoringBundle, stream: DataFrame, output_path: str, checkpoint: str,
                         passthrough=(), available_now: bool = True, fmt: str = "parquet"):
    """Score every micro-batch and write it under ``output_path/epoch=<id>``
    (overwrite per epoch, so a retried batch replaces its own files).
    Returns the started query."""
    def process(batch: DataFrame, epoch_id: int):
        (score(bundle, batch, passthrough=passthrough)
         .write.mode("overwrite").format(fmt).save(f"{output_path}/epoch={epoch_id}"))

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def run_to_table(scored: DataFrame, name: str, checkpoint: str, available_now: bool = True):
    """Drive a scored stream into an in-memory table (tests / demos) with an
    ``availableNow`` trigger; returns the finished query."""
    writer = scored.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint)
    q = writer.trigger(availableNow=True).start() if available_now else writer.start()
    q.awaitTermination()
    return q
