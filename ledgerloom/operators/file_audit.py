"""What each delivered file holds, against what its manifest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, "([^/]+)$", 1))


def listed_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(file_path, bytes) of every file under the root; only the listing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(F.col("path").alias("file_path"), F.col("length").alias("bytes"))


def rows_by_file(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(file_path, rows), from the files' footers: no column is read, so the files may be of different tables."""
    frame = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(root)
    return frame.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("rows"))


def contents_by_file(frame: DataFrame, era: str = "x_SchemaEra") -> DataFrame:
    """(file_path, eras, filled columns) of one table's files, in one scan.  Both lists are bounded by the schema."""
    filled = [F.when(F.count(F.col(c)) > 0, F.lit(c)) for c in frame.columns]
    eras = F.array_join(F.sort_array(F.collect_set(era)), ", ") if era in frame.columns else F.lit(None).cast("string")
    return frame.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        eras.alias("eras"), F.array_compact(F.array(*filled)).alias("filled_columns"))


def file_audit(files: DataFrame, found: DataFrame, stated: DataFrame) -> DataFrame:
    """A verdict on every file that was delivered or stated.

    files: (file_path, bytes); found: (file_path, rows); stated: (file_name, rows_stated).  A file without rows is listed
    though no scan can see it: it holds none, which may be what its manifest states.
    """
    delivered = files.join(found, "file_path", "left").select(
        file_name(F.col("file_path")).alias("file_name"), "bytes", F.coalesce("rows", F.lit(0).cast("long")).alias("rows_found"))
    verdict = (F.when(F.col("rows_found").isNull(), "MISSING").when(F.col("rows_stated").isNull(), "NOT STATED")
               .when(F.col("rows_found") == F.col("rows_stated"), "MATCH").otherwise("MISMATCH"))
    return delivered.join(stated, "file_name", "full_outer").withColumn("verdict", verdict)
