"""Folds and labels shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out from every fit."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)).cast("int")


def labelled(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, fold) of the rows that may be learnt from; repeated ids count once, with their largest label."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.withColumn("fold", fold()).where("fold <> 1")
