"""Reading bill exports, their manifests, and the text companions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schema
from ledgerloom.operators.tokens import USAGE_SCHEMA

MANIFEST_FIELDS = (
    "dataRowCount bigint, exportConfig struct<exportName:string,resourceId:string,dataVersion:string>, "
    "runInfo struct<executionType:string,runId:string>, "
    "blobs array<struct<blobName:string,dataRowCount:bigint>>"
)


def stored(read: Callable[[str], DataFrame], path: str) -> DataFrame | None:
    """What a reader finds under the path, or None where nothing has been written; any other fault is the caller's to see."""
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def folder_label(path: Column) -> Column:
    """The folder a file lies in, read from its path."""
    return F.url_decode(F.regexp_extract(path, "([^/]+)/[^/]+$", 1))


def read_export(spark: SparkSession, *paths: str) -> DataFrame:
    """A bill export; several part files or folders are one read.

    A pull folder also holds its manifest, which is not part of the table.
    """
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(*paths)


def read_labelled_exports(spark: SparkSession, root: str) -> DataFrame:
    """Every pull under a root, one subfolder each, kept apart by that folder's name."""
    return (
        spark.read.option("mergeSchema", "true").parquet(f"{root}/*/*.parquet")
        .withColumn("drop_id", folder_label(F.col("_metadata.file_path")))
    )


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per drop: version, run, and the row count it states."""
    return (
        spark.read.schema(MANIFEST_FIELDS).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "manifest.json").json(root)
        .select(folder_label(F.col("_metadata.file_path")).alias("drop_id"),
                F.col("exportConfig.exportName").alias("export_name"),
                F.col("exportConfig.dataVersion").alias("data_version"),
                F.col("runInfo.runId").alias("run_id"), F.col("dataRowCount").alias("rows_stated"),
                F.size("blobs").alias("part_files"))
    )


def missing_drops(manifests: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected pulls that did not arrive; reported rather than skipped."""
    return expected.join(manifests.select("drop_id"), "drop_id", "left_anti")


def read_companion(spark: SparkSession, path: str, declared: T.StructType) -> DataFrame:
    """A companion CSV as text.  An empty field is NULL, and a header that does
    not match the declared columns is an error rather than a shifted read."""
    return spark.read.schema(declared).option("enforceSchema", "false").option("escape", '"').csv(path, header=True)


def read_billing_periods(spark: SparkSession, path: str) -> DataFrame:
    return read_companion(spark, path, schema.BILLING_PERIOD_SCHEMA)


def read_invoice_detail(spark: SparkSession, path: str) -> DataFrame:
    return read_companion(spark, path, schema.INVOICE_DETAIL_SCHEMA).withColumn(
        "BilledCost", F.expr("try_cast(BilledCost AS DECIMAL(28,4))"))


def read_contract_commitments(spark: SparkSession, path: str) -> DataFrame:
    return read_companion(spark, path, schema.CONTRACT_COMMITMENT_SCHEMA).withColumns({
        "ContractCommitmentCost": F.expr("try_cast(ContractCommitmentCost AS DECIMAL(28,4))"),
        "ContractCommitmentPeriodStart": F.to_date(F.substring("ContractCommitmentPeriodStart", 1, 10)),
        "ContractCommitmentPeriodEnd": F.to_date(F.substring("ContractCommitmentPeriodEnd", 1, 10)),
    })


def read_token_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TOKEN_LOG_SCHEMA).csv(path, header=True)


def read_batch_output(spark: SparkSession, path: str) -> DataFrame:
    """Batch output lines with their nested usage block."""
    return spark.read.schema(USAGE_SCHEMA[len("struct<"):-1].replace("response:", "response ", 1)).json(path)
