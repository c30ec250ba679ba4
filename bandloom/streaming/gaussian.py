"""Gaussian models kept up to date on streams, and prediction of arriving pixels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandloom.operators import gaussian, prepare
from bandloom.operators.learners import Fitted
from bandloom.operators.prepare import Scaler
from bandloom.session import scratch_path
from bandloom.sources.tables import PIXEL_KEY


def stream_moments(samples: DataFrame, d: int, shift=None) -> DataFrame:
    """Running n, sums and cross sums per class of a stream of samples.

    The state is one row per class. Sums do not depend on the order of arrival,
    so the result equals a batch over the same rows.
    """
    labelled = samples.filter(F.col("label").isNotNull())
    return labelled.groupBy("label").agg(*gaussian.moment_columns(d, shift))


def stream_gmm_fit(
    samples: DataFrame, d: int, on_model: Callable[[gaussian.GaussianModel, int], None], checkpoint: str | None = None,
    available_now: bool = False, tau: float = 0.0, shift: Sequence[float] | None = None,
) -> StreamingQuery:
    """Refit the model from the running moments after every micro-batch.

    `on_model(model, batch_id)` receives the model; only the per-class rows ever
    reach the driver. `shift` is taken off the bands before squares are summed, for
    bands far from zero; it must stay the same for the life of the checkpoint.
    """

    def refit(table: DataFrame, batch_id: int) -> None:
        held = table.persist()
        try:
            if not held.isEmpty():
                on_model(gaussian.fit_from_moments(held, d, tau, shift), batch_id)
        finally:
            held.unpersist()

    writer = stream_moments(samples, d, shift).writeStream.outputMode("complete").foreachBatch(refit)
    writer = writer.option("checkpointLocation", checkpoint or scratch_path(samples.sparkSession, "stream"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_moment_table(samples: DataFrame, d: int, path: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return the final moment table.

    Every micro-batch writes a table of its own below `path` and is then published
    by its number, so readers never see half a table and a replayed batch changes nothing.
    """
    spark = samples.sparkSession

    def store(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        spark.range(batch_id, batch_id + 1).write.mode("overwrite").parquet(f"{path}/published/{batch_id}")

    query = (
        stream_moments(samples, d).writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest_moments(spark, path)


def latest_moments(spark: SparkSession, path: str) -> DataFrame:
    """The moment table that was published last below `path`."""
    last = spark.read.schema("id bigint").option("recursiveFileLookup", "true").parquet(f"{path}/published").agg(F.max("id")).first()[0]
    return spark.read.parquet(f"{path}/batch={last}")


def stream_predict(pixels: DataFrame, fitted: Fitted, scaler: Scaler | None = None, nodata: float | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """Class and confidence of arriving pixels with a fixed model; no state."""
    keep = PIXEL_KEY if keep is None else keep
    slim = prepare.valid_pixels(pixels, nodata).select(*keep, "bands")
    return fitted.predict(scaler.transform(slim) if scaler else slim, keep)


def stream_to_table(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Append a stream to Parquet until its present input is used up."""
    spark: SparkSession = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
