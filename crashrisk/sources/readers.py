"""Scans of incident tables, landed pages and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashrisk.sources.schemas import CRASHES, layout


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with an explicit schema: no inference job, columns and filters pushed down."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_crashes(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CRASHES)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, drop: list[str] | None = None) -> DataFrame:
    """CSV with a header; dropped columns are never parsed."""
    wanted = [f.name for f in schema.fields if f.name not in (drop or [])]
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
            .select(*[F.col(f"`{c}`") for c in wanted]))


def explode_feature_pages(pages: DataFrame, text: str, attributes: str) -> tuple[DataFrame, DataFrame]:
    """Landed feature pages (JSON text) -> one row per feature, and the rejected pages.

    A page is ``{features: [{attributes: {...}}], exceededTransferLimit, error}``. As a
    download fails as a whole, no rows are taken of a source (``source`` column, if
    there is one) that has an error page.
    """
    layout = (f"features array<struct<attributes: struct<{attributes}>>>, exceededTransferLimit boolean,"
              "error struct<code: int, message: string>")
    others = [c for c in pages.columns if c != text]
    parsed = pages.select(*others, F.from_json(text, layout).alias("_page"))
    failed = F.col("_page").isNull() | F.col("_page.error").isNotNull() | (
        F.col("_page.features").isNull() & F.col("_page.exceededTransferLimit").isNull())
    rejects = parsed.where(failed).select(*others, F.coalesce("_page.error.message", F.lit("unreadable page")).alias("reason"))
    good = parsed.where(~failed)
    if "source" in others:
        good = good.join(rejects.select("source").distinct(), "source", "left_anti")
    rows = good.select(*others, F.explode("_page.features").alias("_f")).select(*others, "_f.attributes.*")
    return rows, rejects


def read_feature_pages(spark: SparkSession, path: str, attributes: str) -> tuple[DataFrame, DataFrame]:
    """Pages from a landing folder; each subfolder or file prefix before ``-`` is a source."""
    pages = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/-]+)(?:-[^/]*)?\.json$", 1).alias("source"), "value")
    return explode_feature_pages(pages, "value", attributes)


def explode_data_pages(pages: DataFrame, text: str, record: str) -> tuple[DataFrame, DataFrame]:
    """Landed ``{data: [...]}`` pages -> one row per record, and the pages without readable data.

    An empty list is a page without records; a null or broken text, or one without ``data``, is rejected.
    """
    others = [c for c in pages.columns if c != text]
    parsed = pages.select(*others, F.from_json(text, f"data array<struct<{record}>>")["data"].alias("_data"))
    rejects = parsed.where("_data IS NULL").select(*others, F.lit("unreadable page").alias("reason"))
    return parsed.select(*others, F.explode("_data").alias("_r")).select(*others, "_r.*"), rejects


RUN_LOG = layout("run_timestamp STRING, outcome STRING, dry_run BOOLEAN, merged_rows STRING, merged_gcs_path STRING").add(
    "new_years", T.ArrayType(T.IntegerType()))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON run logs of a folder; unreadable ones and those without stamp or outcome are skipped."""
    return keep_complete_logs(spark.read.schema(RUN_LOG).option("multiLine", True).json(path))


def keep_complete_logs(logs: DataFrame) -> DataFrame:
    return logs.where("run_timestamp <> '' AND outcome <> ''")
