"""Merge plans and job manifests in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "final_order int, unit_id string, source_pdf string, include_in_merged_pdf boolean, exclude_reason string, merge_candidate boolean, bookmark_title string, bookmark_label string, act_title string, act_number string, act_category string, "
    "suggested_order int, sort_group string, sort_priority int, faldone_number int, index_date string, pg_progressive int, total_pages int, warnings array<struct<code: string, message: string, path: string>>"
)
MANIFEST = "schema_version int, job struct<status: string, id: string>, processing struct<ocr_searchable_pdf_requested: boolean>, outputs struct<markdown: string, index_markdown: string, searchable_pdf: string, run_log: string, manifest: string>"


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """The items of plan files, one row each, with casefile_id (the file's folder) and plan_file. Fails on a file that is no JSON
    object; an item without unit or source keeps its nulls for the validation to report."""
    raw = spark.read.schema(f"items array<struct<{', '.join(f'{c.split()[0]}: {c.split(maxsplit=1)[1]}' for c in _fields(ITEM))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    at = raw.select(F.input_file_name().alias("plan_file"), F.posexplode("items").alias("n", "i"))
    return at.select("plan_file", F.regexp_extract("plan_file", r"([^/]+)/[^/]+$", 1).alias("casefile_id"), (F.col("n") + 1).cast("long").alias("item_id"), "i.*")


def _fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def prefer_revised(items: DataFrame, revised: str = "fascicolo_merge_plan_revised.json") -> DataFrame:
    """Of the plans of one folder, the items of the file named `revised` where there is one."""
    is_revised = (F.regexp_extract("plan_file", r"[^/]*$", 0) == revised).cast("int")
    best = items.groupBy("casefile_id").agg(F.max(is_revised).alias("best"))
    return items.join(best, "casefile_id").where(is_revised == F.col("best")).drop("best")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("manifest_file", F.input_file_name())
