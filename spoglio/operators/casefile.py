"""Operators on case folders: documents, units, index entries, merge plans.

Every relation carries casefile_id, so that windows and groups stay within a folder. Rows delivered twice are
expected to be removed with `once` first. Null keys group together; null paths, names and hashes match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoglio.functions import rules
from spoglio.functions import text as T

INDEX_NAME = "ListaAllegati.html"


def once(df: DataFrame, *key: str, arrival: str = "ingested_at") -> DataFrame:
    """One row for each key: records delivered again with the same values count once."""
    return df.drop(arrival).dropDuplicates(list(key))


def duplicate_files(docs: DataFrame) -> DataFrame:
    """Files whose content came earlier in the scan of the same folder, with the path of the first. A marker file is never
    reported but may be the first. Null hashes are no duplicates."""
    scan = Window.partitionBy("casefile_id", "sha256").orderBy("scan_ord", "case_doc_id")
    seen = docs.where("sha256 is not null").withColumn("first_path", F.first("relative_path").over(scan)).withColumn("rank", F.row_number().over(scan))
    return seen.where((F.col("rank") > 1) & (F.coalesce("document_type", F.lit("")) != "marker_tecnico")).select("case_doc_id", "casefile_id", "relative_path", "first_path")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Contents that occur more than once in a folder."""
    groups = docs.where("sha256 is not null").groupBy("casefile_id", "sha256").agg(F.count("*").alias("n_files"), F.min_by("relative_path", F.struct("scan_ord", "case_doc_id")).alias("first_path"), F.sum("size_bytes").alias("size_bytes"))
    return groups.where("n_files > 1")


def build_units(docs: DataFrame) -> DataFrame:
    """Roll-up by the numeric top directory; a unit without any PDF is dropped. Files in deeper folders count for their unit."""
    path, name = F.col("relative_path"), T.basename(F.col("relative_path"))
    inside = docs.where(path.rlike(r"^\d+/")).withColumn("unit_id", T.top_segment(path)).withColumn("ext", T.suffix(name)).withColumn("name", name)
    at = F.struct("scan_ord", "case_doc_id")
    units = inside.groupBy("casefile_id", "unit_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("ext") == ".pdf").alias("total_pdf_files"), F.count_if(F.col("ext") != ".pdf").alias("total_non_pdf_files"), F.sum("size_bytes").alias("size_bytes"),
        F.min_by(F.when(F.col("relative_path") == F.concat("unit_id", F.lit("/"), "unit_id", F.lit(".pdf")), path), F.when(F.col("relative_path") == F.concat("unit_id", F.lit("/"), "unit_id", F.lit(".pdf")), at)).alias("main_pdf_path"),
        F.min_by(F.when(F.col("name") == INDEX_NAME, path), F.when(F.col("name") == INDEX_NAME, at)).alias("attachment_index_path"),
        F.min_by(F.when(F.col("name") == rules.MARKER, path), F.when(F.col("name") == rules.MARKER, at)).alias("complete_marker_path"),
    )
    return units.where("total_pdf_files > 0")


def unit_hashes(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Each unit with the hash of its main document, null if there is none."""
    have = docs.select("casefile_id", F.col("relative_path").alias("main_pdf_path"), "sha256")
    return units.select("casefile_id", "unit_id", "main_pdf_path").join(have, ["casefile_id", "main_pdf_path"], "left").select("casefile_id", "unit_id", "main_pdf_path", "sha256")


# What counts as an image.
IMAGES = (".tif", ".tiff", ".jpg", ".jpeg", ".png", ".bmp", ".gif")


def case_profile(docs: DataFrame, units: DataFrame) -> DataFrame:
    """The kind of each folder by its files and units, how sure that is, and why."""
    files = docs.groupBy("casefile_id").agg(F.count("*").alias("total"), F.count_if(F.lower("extension") == ".pdf").alias("n_pdf"), F.count_if(F.lower("extension").isin(*IMAGES)).alias("n_images"), F.count_if(F.col("filename") == INDEX_NAME).alias("n_indexes"))
    have = units.groupBy("casefile_id").agg(F.count("*").alias("n_units"), F.count_if(F.col("attachment_index_path") != "").alias("n_indexed"))
    both = files.join(have, "casefile_id", "left").na.fill(0, ["n_units", "n_indexed"])
    t, p, i, u, x, k = (F.col(c) for c in ("total", "n_pdf", "n_images", "n_units", "n_indexes", "n_indexed"))
    percent = lambda n: F.bround(n / t * 100, 0).cast("long")
    sure = lambda n: F.when(percent(n) >= 80, "high").otherwise("medium")
    say = lambda form, *xs: F.format_string(form, *xs)
    of = lambda kind, confidence, reason: F.struct(F.lit(kind).alias("profile"), confidence.alias("confidence"), reason.alias("reason"))
    found = (
        F.when((u >= 2) & (x > 0) & (p >= 2), of("ministeriale_tiap", F.lit("high"), say(f"rilevate %d unità con %d {INDEX_NAME} e PDF principale numerico", u, k)))
        .when(((p > 0) & (i > 0)) | ((u > 0) & (p + i < t)), of("misto", F.lit("medium"), say("%d PDF, %d immagini, %d unità TIAP su %d file totali", p, i, u, t)))
        .when((x == 0) & (i > 0) & (i / t >= 0.5) & (p <= i), of("immagini_scansioni", sure(i), say("%d/%d file immagine (%d%%), %d PDF, nessun indice allegati", i, t, percent(i), p)))
        .when((x == 0) & (u == 0) & (p > 0) & (p / t >= 0.5), of("pdf_sciolti", sure(p), say("%d/%d PDF (%d%%), assenza struttura TIAP e indici allegati", p, t, percent(p))))
        .otherwise(of("sconosciuto", F.lit("low"), say("%d file, nessun pattern strutturale riconosciuto", t)))
    )
    return both.withColumn("found", found).select(*both.columns, "found.*")


def running(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, bucket: Column) -> DataFrame:
    """df with the sum of `value` over a group's rows up to each one, in two steps: within buckets, and over the buckets' sums, so that one large group is worked by many
    tasks. `bucket` must not fall along `order`. Rows of a null group stand for themselves."""
    key = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]
    rows = df.withColumn("__g", F.concat_ws("\x00", *key)).withColumn("__b", bucket).withColumn("__v", value)
    sums = rows.groupBy("__g", "__b").agg(F.sum("__v").alias("__s"))
    ahead = F.sum("__s").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__g", "__b", F.coalesce(ahead, F.lit(0)).alias("__a"))
    inner = F.sum("__v").over(Window.partitionBy("__g", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__i", inner).join(sums, ["__g", "__b"])
    return out.withColumn(name, (F.coalesce("__i", F.lit(0)) + F.col("__a")).cast("long")).drop("__g", "__b", "__v", "__i", "__a")


def largest_files(docs: DataFrame, n: int = 10) -> DataFrame:
    """The n largest files of each folder; ties in scan order."""
    w = Window.partitionBy("casefile_id").orderBy(F.desc("size_bytes"), "scan_ord", "case_doc_id")
    return docs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n).select("casefile_id", "rank", "case_doc_id", "size_bytes")


def detect_indexes(docs: DataFrame) -> DataFrame:
    """The files that may be indexes with a confidence and format."""
    path = F.col("relative_path")
    ext = T.suffix(T.basename(path))
    found = docs.select("casefile_id", "relative_path", rules.index_confidence(path).alias("confidence"), F.when(ext.isin(".html", ".htm"), "html").when(ext == ".xml", "xml").when(ext == ".txt", "text").when(ext == ".csv", "csv").otherwise("unknown").alias("detected_format"))
    return found.where("confidence is not null")


def match_entries(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Cascade of exact matches: path, name, folded name. The first level with candidates decides; more than one there is
    ambiguous and matches nothing. Every entry gets one of path_exact, basename_exact, normalized_basename,
    ambiguous, unmatched, no_reference. Documents are grouped by key before the join, so no entry multiplies."""
    ref = T.reference_path(F.col("referenced_path"))
    e = entries.select("entry_id", "casefile_id", F.lower(ref).alias("k1"), F.lower(F.regexp_extract(ref, r"[^/]*$", 0)).alias("k2"), F.trim(F.regexp_replace(T.fold(F.regexp_extract(ref, r"[^/]*$", 0)), r"[\s_-]+", " ")).alias("k3"))
    path = F.col("relative_path")
    keys = {"k1": F.lower(T.slashes(path)), "k2": F.lower(F.regexp_extract(T.slashes(path), r"[^/]*$", 0)), "k3": F.trim(F.regexp_replace(T.fold(F.regexp_extract(T.slashes(path), r"[^/]*$", 0)), r"[\s_-]+", " "))}
    for k, expr in keys.items():
        grouped = docs.where("relative_path is not null").groupBy("casefile_id", expr.alias(k)).agg(F.count("*").alias(f"n_{k}"), F.min("case_doc_id").alias(f"doc_{k}"))
        e = e.join(grouped, ["casefile_id", k], "left")
    level = F.when(F.col("n_k1").isNotNull(), "k1").when(F.col("n_k2").isNotNull(), "k2").when(F.col("n_k3").isNotNull(), "k3")
    n = F.coalesce("n_k1", "n_k2", "n_k3")
    doc = F.when(F.col("n_k1").isNotNull(), F.col("doc_k1")).when(F.col("n_k2").isNotNull(), F.col("doc_k2")).otherwise(F.col("doc_k3"))
    strategy = F.when(F.col("k1").isNull(), "no_reference").when(level.isNull(), "unmatched").when(n > 1, "ambiguous").when(level == "k1", "relative_path_exact").when(level == "k2", "basename_exact").otherwise("normalized_basename")
    confidence = F.when(strategy.isin("relative_path_exact", "basename_exact"), "high").when(strategy == "normalized_basename", "medium")
    return e.select("entry_id", "casefile_id", strategy.alias("strategy"), confidence.alias("confidence"), F.when(confidence.isNotNull(), doc).alias("case_doc_id"))


def unit_order(units: DataFrame) -> DataFrame:
    """The order of a folder's units by file number, date, protocol and unit; a missing file number goes first, a missing date
    and protocol last. Impossible years sort by their value and are flagged."""
    day = T.day_key(F.col("index_date"))
    u = units.select("unit_key", "casefile_id", "unit_id", "faldone_number", "pg_progressive", day.alias("day"))
    number = F.coalesce(F.col("unit_id").try_cast("long"), F.lit(999_999_999))
    order = [F.coalesce("faldone_number", F.lit(0)), F.col("day.y"), F.col("day.m"), F.col("day.d"), F.coalesce("pg_progressive", F.lit(999_999)), number, F.col("unit_key")]
    u = running(u, ["casefile_id"], order, F.lit(1), "suggested_order", F.coalesce(F.col("faldone_number"), F.lit(0)).cast("long") * 10_000 + F.col("day.y"))
    kind = F.when(F.col("faldone_number").isNotNull(), "faldone+data+pg+unit_id").when(F.col("day.y") != 9999, "data+pg+unit_id").when(F.col("pg_progressive").isNotNull(), "pg+unit_id").otherwise("unit_id")
    return u.select("unit_key", "casefile_id", "suggested_order", kind.alias("order_source"), F.when(F.col("day.odd") | (kind == "unit_id"), "low").otherwise("high").alias("order_confidence"), F.col("day.odd").alias("anomalous_date"))


def unit_bookmark(number: Column, title: Column, unit: Column, most: int = 100) -> Column:
    """Number of at least three digits and title, else the unit's name."""
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    label = F.concat_ws(" - ", padded, T.null_if_empty(F.trim(title)))
    return T.shorten(F.coalesce(T.null_if_empty(label), F.concat(F.lit("Unità "), unit)), most)


def plan_bookmark(title: Column, unit: Column, most: int = 100) -> Column:
    """Title without leading numbers and surrounding punctuation, else the unit's name."""
    clean = F.btrim(F.regexp_replace(T.squeeze(F.coalesce(title, F.lit(""))), r"^\s*\d+\s*(?:[-–—.:)]\s*)+", ""), F.lit(" -–—.:)"))
    return T.shorten(F.coalesce(T.null_if_empty(clean), F.concat(F.lit("Unità "), unit)), most, strip=True)


def _plan_order() -> list[Column]:
    return [F.asc_nulls_last("final_order"), F.asc("item_id")]


def _along_plan(items: DataFrame, value: Column, name: str) -> DataFrame:
    return running(items, ["casefile_id"], _plan_order(), value, name, F.coalesce(F.floor(F.col("final_order") / 4096), F.lit(1 << 40) + F.floor(F.col("item_id") / 4096)))


def renumber_plan(items: DataFrame) -> DataFrame:
    """New order 1..n over a folder's included items in their present order; null for excluded ones. Labels follow."""
    rows = _along_plan(items, F.coalesce(F.col("include_in_merged_pdf"), F.lit(True)).cast("long"), "__n")
    n = F.when(F.coalesce(F.col("include_in_merged_pdf"), F.lit(True)), F.col("__n"))
    title = plan_bookmark(F.col("act_title"), F.col("unit_id"))
    out = rows.select("item_id", "casefile_id", n.alias("new_order"), title.alias("new_title"))
    number = F.col("new_order").cast("string")
    return out.withColumn("new_label", F.when(F.col("new_order").isNotNull(), F.concat_ws(" - ", F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0")), "new_title")))


def set_included(items: DataFrame, unit_ids: list[str], included: bool, reason: str | None = None) -> DataFrame:
    """The plan with the named units included or excluded; a reason is kept for excluded ones only."""
    hit = F.col("unit_id").isin(unit_ids)
    return items.withColumn("include_in_merged_pdf", F.when(hit, F.lit(included)).otherwise(F.col("include_in_merged_pdf"))).withColumn("exclude_reason", F.when(hit, F.lit(None if included else reason).cast("string")).otherwise(F.col("exclude_reason")))


def set_title(items: DataFrame, unit_id: str, title: str) -> DataFrame:
    return items.withColumn("act_title", F.when(F.col("unit_id") == unit_id, F.lit(title)).otherwise(F.col("act_title")))


def move_item(items: DataFrame, casefile_id: str, source: int, target: int) -> DataFrame:
    """One item of a folder moved from a position to another (from 1, by the present order); the items between move up or down.
    Result: item_id, casefile_id, position."""
    p = F.col("position")
    step = F.when(p == source, F.lit(target)).when((p > source) & (p <= target), p - 1).when((p < source) & (p >= target), p + 1).otherwise(p)
    return _along_plan(items, F.lit(1), "position").select("item_id", "casefile_id", "position").withColumn("position", F.when(F.col("casefile_id") == casefile_id, step).otherwise(p).cast("long"))


def page_offsets(items: DataFrame) -> DataFrame:
    """Start and end page (from 0) of each included item with known pages in its folder's merged file."""
    pages = items.where("include_in_merged_pdf and total_pages > 0").withColumn("total_pages", F.col("total_pages").cast("long"))
    pages, end = _along_plan(pages, F.col("total_pages"), "__end"), F.col("__end")
    return pages.select("item_id", "casefile_id", (end - F.col("total_pages")).alias("start_page"), (end - 1).alias("end_page"))


def plan_totals(items: DataFrame) -> DataFrame:
    """Counts and pages of each folder's plan: the sum of the pages known, null if none is; and the estimate, null if any
    included item's pages are unknown."""
    inc = F.col("include_in_merged_pdf")
    pages = F.when(inc, F.col("total_pages").cast("long"))
    return items.groupBy("casefile_id").agg(
        F.count("*").alias("n_items"), F.count_if(inc).alias("n_included"), F.count_if(~inc).alias("n_excluded"), F.sum(pages).alias("known_pages"),
        F.when(F.count_if(inc) == F.count(pages), F.coalesce(F.sum(pages), F.lit(0))).alias("estimated_pages"), F.count_if(F.size("warnings") > 0).alias("n_warned"),
    )


def unsafe_paths(items: DataFrame) -> DataFrame:
    """Plan items whose source leaves the folder: absolute, a drive or URL, or through `..`; as rows, not as an exception."""
    p = T.slashes(F.col("source_pdf"))
    return items.where(p.rlike(r"^(?:/|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*://)") | F.array_contains(F.split(p, "/"), "..")).select("item_id", "casefile_id", T.safe_reference(F.col("source_pdf")).alias("safe_source"))


def plan_warnings(items: DataFrame) -> DataFrame:
    """The warnings carried by plan items, one row each."""
    w = items.select("item_id", "casefile_id", F.posexplode("warnings").alias("n", "w"))
    return w.select("item_id", "casefile_id", (F.col("n") + 1).cast("long").alias("n"), F.col("w.code").alias("code"), F.col("w.message").alias("message"), T.safe_reference(F.col("w.path")).alias("path"))


def tile_pages(df: DataFrame, key: str, pages: str, block: int) -> DataFrame:
    """Blocks of `block` pages: block_no, first_page, last_page, from 1; nothing for null or no pages."""
    n = F.col(pages).cast("long")
    at = df.where(n > 0).select(key, n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(block).cast("long"))).alias("start"))
    return at.select(key, (F.floor(F.col("start") / block) + 1).cast("long").alias("block_no"), (F.col("start") + 1).alias("first_page"), F.least(F.col("start") + block, F.col("n")).alias("last_page"))
