"""Imputing target files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.impute import Imputer

SCHEMA = "sample_idx int, marker_idx int, ll_00 double, ll_01 double, ll_11 double"


def impute_stream(spark: SparkSession, imputer: Imputer, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Likelihood files (Parquet, one or more whole samples each) to imputed Parquet; a sample needs no state of earlier ones."""

    def batch(df: DataFrame, number: int) -> None:
        imputer.impute(df).imputed.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return spark.readStream.schema(SCHEMA).parquet(folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
