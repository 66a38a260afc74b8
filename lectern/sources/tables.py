"""Catalogue tables read from Parquet, and adapters that give the benchmark tables that shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(key, item_type, title, author, date, doi, collections): parts read as catalogue items.

    Every tenth of the keys shares a DOI with its neighbours, written in different ways.
    """
    k = F.col("p_partkey")
    prefix = F.when(k % 3 == 0, "https://doi.org/10.1000/X").when(k % 3 == 1, "doi: 10.1000/x").otherwise("10.1000/X")
    return read(spark, folder, "part").select(
        k.alias("key"), F.col("p_type").alias("item_type"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
        F.when(F.col("p_size") < 48, F.concat(F.lit("May "), (F.col("p_size") + 1970).cast("string"))).alias("date"),
        F.when(k % 20 < 2, F.concat(prefix, F.floor(k / 20).cast("string"))).alias("doi"),
        F.when(k % 4 > 0, F.array(F.concat(F.lit("C"), (k % 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("collections"),
    )


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """(key, parent, content_type, year): order lines read as attachments of the parts."""
    return read(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.col("l_partkey").alias("parent"),
        F.when(F.col("l_returnflag") == "A", "application/pdf").otherwise("text/html").alias("content_type"), F.year("l_shipdate").alias("year"),
    )
