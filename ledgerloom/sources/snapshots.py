"""Snapshots of the specification, as they are published: one JSON object a file, column -> what is said of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "struct<column_id:string, tag:string, dataset:string, display_name:string, feature_level:string, allows_nulls:string, "
    "data_type:string, value_format:string, column_type:string, introduced:string, introduced_note:string, "
    "allowed_values:array<string>, requirements:array<struct<text:string, severity:string, indent:int>>, raw_url:string>"
)
LIFECYCLE = "struct<introduced:map<string,string>, removed:map<string,string>>"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_snapshots(spark: SparkSession, *paths: str) -> DataFrame:
    """The rule table of the snapshots: a row for each tag, dataset and column.

    requirements holds the sentences and stated the severity that the snapshot gives each.  Tags are ordered by their
    numbers, so v1.10 follows v1.9.  A file that is not such an object gives no row.
    """
    parsed = None
    for path in paths:
        rows = _documents(spark, path).select(F.explode(F.from_json("value", f"map<string,{RECORD}>")).alias("name", "r"))
        parsed = rows if parsed is None else parsed.unionByName(rows)
    numbers = F.split(F.regexp_replace("tag", "[^0-9.]", ""), r"\.")
    order = F.coalesce(F.get(numbers, F.lit(0)).try_cast("int"), F.lit(0)) * 1000 + F.coalesce(F.get(numbers, F.lit(1)).try_cast("int"), F.lit(0))
    return parsed.select("name", "r.*").select(
        "tag", order.alias("tag_order"), "dataset", F.coalesce("column_id", "name").alias("column_id"), "feature_level", "allows_nulls",
        "data_type", "value_format", F.coalesce("introduced", F.lit("")).alias("introduced"),
        F.coalesce("introduced_note", F.lit("")).alias("introduced_note"),
        F.coalesce("allowed_values", F.expr("CAST(array() AS array<string>)")).alias("allowed_values"),
        F.transform("requirements", lambda r: r["text"]).alias("requirements"),
        F.transform("requirements", lambda r: r["severity"]).alias("stated"))


def read_lifecycle(spark: SparkSession, path: str) -> DataFrame:
    """(column_id, introduced, removed) of the lifecycle map; a column that is still there has no removal."""
    both = _documents(spark, path).select(F.from_json("value", LIFECYCLE).alias("l"))
    came = both.select(F.explode("l.introduced").alias("column_id", "introduced"))
    went = both.select(F.explode("l.removed").alias("column_id", "removed"))
    return came.join(went, "column_id", "full_outer")
