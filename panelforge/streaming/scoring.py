"""Scoring feature rows as they arrive, with models that may change while the stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge.operators.models import TierModel, load_model, predict_with_tier_models, save_model
from panelforge.sources import snapshots


def score_stream(rows: DataFrame, models: dict[str, TierModel], name: str = "model_prediction") -> DataFrame:
    """Stream of feature rows with predictions of fixed models: a narrow transform and one stream-static join."""
    return predict_with_tier_models(rows, models, name)


def publish_models(models: dict[str, TierModel], root: str) -> int:
    """Save a set of tier models as the next version; a version is listed when all of its models are there."""
    spark = next(iter(models.values())).entities.sparkSession
    version = snapshots.current_version(spark, root) + 1
    listed = {}
    for tier, model in models.items():
        place = f"v{version}-{tier}"
        save_model(model, f"{root}/models/{place}")
        listed[(tier,)] = place
    snapshots.publish(spark, root, version, listed)
    return version


def newest_models(spark: SparkSession, root: str) -> tuple[int, dict[str, TierModel]]:
    """The newest complete set of models and its version."""
    version = snapshots.current_version(spark, root)
    if version == 0:
        raise FileNotFoundError(f"no models at {root}")
    listed = snapshots.read_manifest(spark, root, version)
    return version, {tier: load_model(spark, f"{root}/models/{place}") for (tier,), place in sorted(listed.items())}


def score_with_newest(
    rows: DataFrame, models: str, out: str, checkpoint: str, name: str = "model_prediction", available_now: bool = True
) -> StreamingQuery:
    """Score every micro-batch with the newest models published when it starts.

    The rows of a batch are written to a folder of its number, with ``model_version``; a batch that is run again replaces its
    own folder, so nothing is written twice.  Read the result with :func:`read_scored`.
    """
    loaded: dict[int, dict[str, TierModel]] = {}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = snapshots.current_version(spark, models)
        if version not in loaded:
            version, found = newest_models(spark, models)
            loaded.clear()
            loaded[version] = found
        scored = predict_with_tier_models(batch, loaded[version], name).withColumn("model_version", F.lit(version))
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    """All scored rows, each batch once."""
    return spark.read.parquet(out).drop("batch")
