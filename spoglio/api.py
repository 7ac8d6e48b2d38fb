"""A folder of case files analysed end to end: one lazy DAG, a DataFrame for each relation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoglio.functions import rules
from spoglio.functions import text as T
from spoglio.operators import casefile as C
from spoglio.session import materialize
from spoglio.sources import indexes
from spoglio.sources.casedir import register


@dataclass(frozen=True)
class Analysis:
    documents: DataFrame
    indexes: DataFrame
    entries: DataFrame
    matches: DataFrame
    units: DataFrame
    plan: DataFrame
    duplicates: DataFrame
    profiles: DataFrame


def analyze(spark: SparkSession, root: str, hashes: bool = True) -> Analysis:
    """All case folders below `root`. The scan is written once to the shared folder, with the bytes of index files only; everything
    else follows from that table. A file that can't be parsed gives an entry with a warning and stops nothing."""
    register(spark)
    scan = spark.read.format("casedir").option("content", "true").option("hash", str(hashes).lower()).load(root)
    scan = materialize(scan, "scan")
    path = F.col("relative_path")
    kind = rules.file_type(path)
    documents = scan.select(
        F.xxhash64("casefile_id", "relative_path").alias("case_doc_id"), "casefile_id", T.document_id(path).alias("id"), "filename", "relative_path", "extension", "size_bytes", T.leading_number(F.col("filename")).alias("file_order"),
        kind["kind"].alias("document_type"), kind["confidence"].alias("type_confidence"), F.lit("filename").alias("type_source"), "sha256", "scan_ord",
    )
    found = C.detect_indexes(documents)
    files = scan.join(found.select("casefile_id", "relative_path"), ["casefile_id", "relative_path"], "left_semi")
    entries = indexes.parse_indexes(files).withColumn("entry_id", F.xxhash64("casefile_id", "index_path", "row_number"))
    entries = entries.withColumn("document_type_hint", F.nullif(rules.file_type(F.concat_ws(" ", "label", "referenced_path"))["kind"], F.lit("sconosciuto")))
    good = entries.where("warning is null")
    matches = C.match_entries(good, documents)
    acts = indexes.parse_acts(files).withColumnRenamed("index_path", "attachment_index_path")
    units = C.build_units(documents).join(acts, ["casefile_id", "attachment_index_path"], "left")
    units = units.withColumn("description", F.coalesce("pg_protocol", "notes")).withColumn("unit_key", F.xxhash64("casefile_id", "unit_id"))
    category = rules.act_category(F.col("act_title"), F.col("description"))
    units = units.withColumn("act_category", category["kind"]).withColumn("category_confidence", category["confidence"]).withColumn("group", rules.sort_group(F.col("act_category")))
    units = units.join(C.unit_order(units).drop("casefile_id"), "unit_key").withColumn("bookmark_title", C.unit_bookmark(F.col("act_number"), F.col("act_title"), F.col("unit_id")))
    ready = C.running(units.where("main_pdf_path is not null"), ["casefile_id"], [F.col("suggested_order")], F.lit(1), "final_order", F.floor(F.col("suggested_order") / 4096))
    number = F.col("final_order").cast("string")
    title = C.plan_bookmark(F.col("act_title"), F.col("unit_id"))
    label = F.concat(F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0")), F.lit(" - "), title)
    plan = ready.select(
        F.col("unit_key").alias("item_id"), "casefile_id", F.col("final_order").cast("int").alias("final_order"), "unit_id", F.col("main_pdf_path").alias("source_pdf"), F.lit(True).alias("include_in_merged_pdf"), F.lit(None).cast("string").alias("exclude_reason"),
        F.lit(True).alias("merge_candidate"), title.alias("bookmark_title"), label.alias("bookmark_label"), "act_title", "act_number", "act_category", "suggested_order", F.col("group.sort_group").alias("sort_group"), F.col("group.sort_priority").alias("sort_priority"),
        "faldone_number", "index_date", "pg_progressive", "total_pages", F.when(F.col("anomalous_date"), F.array(F.struct(F.lit("anomalous_date").alias("code"), F.concat(F.lit("Data atto anomala: "), "index_date").alias("message"), F.col("attachment_index_path").alias("path")))).alias("warnings"),
    )
    return Analysis(documents, found, entries, matches, units, plan, C.duplicate_files(documents), C.case_profile(documents, units))
