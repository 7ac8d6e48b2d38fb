"""Jobs of text recognition as relations: block progress, names of outputs, manifests and what became of their outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoglio.functions import text as T

OUTPUTS = ("markdown", "index_markdown", "searchable_pdf", "run_log", "manifest")


def duration_text(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s; below zero counts as zero, ties are rounded to even."""
    n = F.greatest(F.lit(0), F.bround(seconds.cast("double"), 0).cast("long"))
    h, m, s = F.floor(n / 3600), F.floor(n / 60) % 60, n % 60
    return F.when(n >= 3600, F.format_string("%dh %02dm %02ds", h, m, s)).when(n >= 60, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def pages_per_minute(pages: Column, seconds: Column) -> Column:
    return F.when(seconds <= 0, 0.0).otherwise(F.bround(pages / (seconds / 60), 3))


def size_reduction(before: Column, after: Column) -> Column:
    """How much smaller in per cent, one decimal; null without a size before."""
    return F.when(before > 0, F.bround((before - after) * F.lit(100.0) / before, 1))


def block_progress(blocks: DataFrame, job: str) -> DataFrame:
    """blocks (job, block_no, pages, seconds, total_pages) -> with percent, seconds_per_page so far, eta_seconds and eta after each block. A job's blocks fit in a task."""
    w = Window.partitionBy(job).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    done, took = F.sum("pages").over(w), F.sum("seconds").over(w)
    out = blocks.withColumn("done_pages", done).withColumn("seconds_per_page", F.when(done > 0, took / done))
    out = out.withColumn("percent", F.when(F.col("total_pages") > 0, F.bround(F.col("done_pages") / F.col("total_pages") * 100, 0).cast("int")))
    eta = F.col("seconds_per_page") * (F.col("total_pages") - F.col("done_pages"))
    return out.withColumn("eta_seconds", eta).withColumn("eta", duration_text(eta))


def slowest_block(blocks: DataFrame, job: str) -> DataFrame:
    """Of each job the block that took longest, the first of equals, with least, mean and total seconds and pages a minute."""
    longest = F.max_by("block_no", F.struct(F.col("seconds"), (-F.col("block_no")).alias("n")))
    return blocks.groupBy(job).agg(longest.alias("block_no"), F.max("seconds").alias("slowest"), F.min("seconds").alias("fastest"), F.avg("seconds").alias("mean"), pages_per_minute(F.sum("pages"), F.sum("seconds")).alias("pages_per_minute"))


def output_names(path: Column, folder: Column) -> Column:
    """struct of the paths of a job's outputs, by the input's name without its suffix."""
    stem, at = T.stem(T.basename(path)), lambda *parts: F.concat(folder, F.lit("/"), *parts)
    named = [at(stem, F.lit("_ocr.md")), at(stem, F.lit("_ocr_index.md")), at(stem, F.lit("_searchable.pdf")), at(F.lit("run.log")), at(F.lit("manifest.json"))]
    return F.struct(*[c.alias(k) for c, k in zip(named, OUTPUTS)])


def first_free(wanted: DataFrame, name: str, taken: DataFrame, path: str, before: str = "", mark: str = "_") -> DataFrame:
    """wanted with column free: `name`, or with the least number from 2 that no taken path has, put before the ending `before`. Names wanted twice get the same one."""
    stem = F.col(name) if not before else F.regexp_replace(name, before.replace(".", r"\.") + "$", "")
    tail = T.slashes(F.col(path))
    numbered = taken.select(F.regexp_replace(tail, (before.replace(".", r"\.") if before else "") + "$", "").alias("__s")).distinct()
    used = numbered.select(F.regexp_replace("__s", rf"{mark}(?:[2-9]|[1-9]\d+)$", "").alias("__base"), F.coalesce(T.null_if_empty(F.regexp_extract("__s", rf"{mark}([2-9]|[1-9]\d+)$", 1)).try_cast("int"), F.lit(1)).alias("__n"))
    whole = numbered.select(F.col("__s").alias("__base"), F.lit(1).alias("__n"))
    have = used.unionByName(whole).groupBy("__base").agg(F.collect_set("__n").alias("__have"))
    joined = wanted.withColumn("__base", stem).join(have, "__base", "left").withColumn("__have", F.coalesce("__have", F.array().cast("array<int>")))
    n = F.when(F.array_contains("__have", 1), F.array_min(F.array_except(F.sequence(F.lit(2), F.size("__have") + 2), F.col("__have")))).otherwise(1)
    return joined.withColumn("free", F.when(n == 1, F.col("__base")).otherwise(F.concat("__base", F.lit(mark), n.cast("string")))).withColumn("free", F.concat("free", F.lit(before))).drop("__base", "__have")


def build_manifests(jobs: DataFrame, app: str = "spoglio", version: str = "1") -> DataFrame:
    """jobs (job_id, path, output_dir, size_bytes, sha256, profile, block_size, structure_markdown, searchable, language, backend, timeout_seconds, started_at) -> the manifest each job begins
    with, as nested columns; `session.materialize` or sources.reports.write_json put it down. What isn't known yet is null."""
    null = lambda kind: F.lit(None).cast(kind)
    none = F.array().cast("array<string>")
    outputs = output_names(F.col("path"), F.col("output_dir"))
    asked = F.coalesce("searchable", F.lit(False))
    return jobs.select(
        F.lit(1).alias("schema_version"), F.struct(F.lit(app).alias("name"), F.lit(version).alias("version")).alias("app"),
        F.struct(F.col("job_id").cast("string").alias("id"), F.col("started_at").cast("string").alias("started_at"), null("string").alias("finished_at"), null("double").alias("duration_seconds"), F.lit("running").alias("status")).alias("job"),
        F.struct("path", T.basename(F.col("path")).alias("filename"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("sha256", F.lit("")).alias("sha256"), null("int").alias("page_count")).alias("input"),
        F.struct(F.col("profile").alias("name"), F.struct("block_size", "structure_markdown").alias("options")).alias("profile"),
        F.struct("block_size", null("int").alias("blocks_total"), F.lit(0).alias("blocks_completed"), asked.alias("ocr_searchable_pdf_requested"), F.col("language").alias("ocr_language")).alias("processing"),
        F.struct("output_dir", *[(outputs[k] if k in ("run_log", "manifest") else null("string")).alias(k) for k in OUTPUTS]).alias("outputs"),
        F.struct(null("string").alias("strategy"), F.lit(0).alias("count"), F.lit(False).alias("fallback"), none.alias("warnings"), F.when(~asked, "searchable_pdf_not_requested").alias("reason")).alias("bookmarks"),
        F.struct(F.col("structure_markdown").alias("enabled"), F.lit(False).alias("post_processed"), F.lit(0).alias("headings_added"), F.when(F.col("structure_markdown"), "conservative_heading_detection").alias("strategy"), none.alias("warnings")).alias("markdown_structure"),
        F.struct(F.col("backend").alias("requested"), null("string").alias("name"), F.lit(False).alias("available"), F.lit(False).alias("used"), F.col("timeout_seconds").alias("ocrmypdf_timeout_seconds"), none.alias("warnings")).alias("ocr_backend"),
        F.struct(*[null("string").alias(k) for k in OUTPUTS[:3]]).alias("output_sha256"), none.alias("warnings"), none.alias("errors"))


def verify_outputs(manifests: DataFrame, listing: DataFrame) -> DataFrame:
    """Each output of each manifest: manifest_file, output, path, required, exists, size_bytes. The Markdown of a successful job is required, the log and the manifest if declared or the job was
    successful, nothing else. listing: path, size_bytes."""
    pairs = F.array(*[F.struct(F.lit(k).alias("output"), T.null_if_empty(F.trim(F.col(f"outputs.{k}"))).alias("path")) for k in OUTPUTS])
    every = manifests.select("manifest_file", F.coalesce(F.col("job.status") == "success", F.lit(False)).alias("ok"), F.explode(pairs).alias("o")).select("manifest_file", "ok", "o.output", "o.path")
    need = F.when(F.col("output") == "markdown", F.col("ok")).when(F.col("output").isin("run_log", "manifest"), F.col("ok") | F.col("path").isNotNull()).otherwise(False)
    have = listing.where("path is not null").groupBy("path").agg(F.max("size_bytes").alias("size_bytes"), F.lit(True).alias("there"))
    return every.join(have, "path", "left").select("manifest_file", "output", "path", need.alias("required"), F.coalesce("there", F.lit(False)).alias("exists"), "size_bytes")


def verification_summary(manifests: DataFrame, verified: DataFrame) -> DataFrame:
    """One row for each manifest: ok, present and required outputs, the missing ones, warnings, and the summary as text."""
    missing = F.col("required") & ~F.col("exists")
    rank = F.array_position(F.array(*map(F.lit, OUTPUTS)), F.col("output"))
    there = lambda k: F.max((F.col("output") == k) & F.col("exists"))
    out = verified.groupBy("manifest_file").agg(
        F.count_if("required").alias("required"), F.count_if(F.col("required") & F.col("exists")).alias("present"), F.array_sort(F.collect_list(F.when(missing, F.struct(rank.alias("r"), "output")))).alias("m"), there("searchable_pdf").alias("pdf"), there("index_markdown").alias("index"))
    asked = manifests.select("manifest_file", F.coalesce(F.col("processing.ocr_searchable_pdf_requested"), F.lit(False)).alias("asked"))
    out = out.join(asked, "manifest_file").withColumn("missing", F.transform("m", lambda x: x["output"]))
    out = out.withColumn("warnings", F.array_compact(F.array(F.when(F.col("asked") & ~F.col("pdf"), F.lit("PDF ricercabile richiesto ma non presente")), F.when(F.col("pdf") & ~F.col("index"), F.lit("Indice Markdown del PDF ricercabile non presente")))))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("Output verificati: "), "present", F.lit("/"), "required")), F.when(F.size("missing") > 0, F.array(F.concat(F.lit("Manca: "), F.array_join("missing", ", ")))).otherwise(F.array().cast("array<string>")), F.transform("warnings", lambda w: F.concat(F.lit("Warning: "), w))), "\n")
    return out.select("manifest_file", (F.size("missing") == 0).alias("ok"), "present", "required", "missing", "warnings", text.alias("summary"))


def chosen_pdf(folders: DataFrame, listing: DataFrame, mode: str, merged: str, light: str) -> DataFrame:
    """folders with column pdf: the file to read, by mode: the light one, the original, or (auto) the light one if there is one; null if there is none.
    folders: output_dir; listing: path."""
    if mode not in ("auto", "light", "original"):
        raise ValueError(f"mode: {mode}")
    have = listing.select(F.regexp_replace("path", r"/[^/]*$", "").alias("output_dir"), T.basename(F.col("path")).alias("n")).where(F.col("n").isin(merged, light)).groupBy("output_dir").agg(F.max(F.col("n") == light).alias("l"), F.max(F.col("n") == merged).alias("o"))
    wanted = {"auto": [("l", light), ("o", merged)], "light": [("l", light)], "original": [("o", merged)]}[mode]
    return folders.join(have, "output_dir", "left").withColumn("pdf", F.coalesce(*[F.when(F.col(c), F.concat("output_dir", F.lit(f"/{n}"))) for c, n in wanted])).drop("l", "o")


def index_rank(confidence: Column) -> Column:
    """The order of indexes: the surest first; then by path, without and with regard to case."""
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).when(confidence == "low", 2).otherwise(3)


def unit_rank(unit_id: Column) -> Column:
    """Units by their number, those without one after them by name."""
    n = unit_id.try_cast("long")
    return F.struct(F.when(n.isNull(), 1).otherwise(0).alias("odd"), F.coalesce(F.lpad(n.cast("string"), 20, "0"), unit_id).alias("key"))


def global_indexes(indexes: DataFrame) -> DataFrame:
    """The sure indexes that list a whole folder: not a unit's own list of attachments. indexes: casefile_id, relative_path, confidence."""
    return indexes.where((F.col("confidence") == "high") & ~F.col("relative_path").rlike(r"^\d+/ListaAllegati\.html$"))


def warning_badge(messages: Column) -> Column:
    """The number of warnings and the first of them, for a list's margin; empty without any."""
    n = F.coalesce(F.size(messages), F.lit(0))
    return F.when(n <= 0, "").when(n == 1, F.get(messages, F.lit(0))).otherwise(F.concat(n.cast("string"), F.lit(" avvisi: "), F.get(messages, F.lit(0)), F.lit(" …")))
