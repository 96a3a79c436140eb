"""Resumable retrieval: new query files are taken up once, joined to the static target keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators import er


def retrieve_stream(spark: SparkSession, path: str, target_keys: DataFrame, out: str, checkpoint: str, profile: er.Profile) -> None:
    """Reads records that arrived below path since the last call and appends their ranked candidates to out.

    A micro-batch holds whole queries, and scores are per query, so no state or watermark is needed.
    """

    def step(batch: DataFrame, number: int) -> None:
        keys = er.route_keys(er.parse(batch))
        er.retrieve(keys, target_keys, profile).write.mode("append").parquet(out)

    rows = spark.readStream.schema("id string, src string, seq long, name string, addr string, country string").parquet(path)
    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
