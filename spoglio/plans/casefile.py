"""Queries over the case-folder tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoglio.catalog import query
from spoglio.functions import rules
from spoglio.functions import text as T
from spoglio.operators import casefile as C
from spoglio.session import table

KEYS = {"casefile_documents": "case_doc_id", "index_entries": "entry_id", "casefile_units": "unit_key", "merge_plan_items": "item_id", "sanitize_results": "job_id", "structure_results": "job_id", "judgment_analyses": "analysis_id"}


def read(spark, sf_dir: str, name: str):
    return C.once(table(spark, sf_dir, name), KEYS[name])


def src(name: str) -> str:
    return f"(SELECT DISTINCT * EXCLUDE (ingested_at) FROM {name})"


DOCS, ENTRIES, UNITS, ITEMS = (src(n) for n in ("casefile_documents", "index_entries", "casefile_units", "merge_plan_items"))
FOLD = "strip_accents(replace(lower({}), 'ß', 'ss'))"


@query("dup_files", f"""SELECT case_doc_id, casefile_id, relative_path, first_path FROM (SELECT *, first_value(relative_path) OVER w AS first_path, row_number() OVER w AS r FROM {DOCS} WHERE sha256 IS NOT NULL
  WINDOW w AS (PARTITION BY casefile_id, sha256 ORDER BY scan_ord, case_doc_id)) WHERE r > 1 AND coalesce(document_type, '') <> 'marker_tecnico'""")
def dup_files(spark, d):
    return C.duplicate_files(read(spark, d, "casefile_documents"))


@query("dup_groups", f"""SELECT casefile_id, sha256, count(*) AS n_files, arg_min(relative_path, (scan_ord, case_doc_id)) AS first_path, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM {DOCS} WHERE sha256 IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def dup_groups(spark, d):
    return C.duplicate_groups(read(spark, d, "casefile_documents"))


@query("document_ids", f"""SELECT case_doc_id, 'doc-' || substr(sha1(replace(relative_path, '\\', '/')), 1, 12) AS id, TRY_CAST(nullif(regexp_extract(filename, '^(\\d{{1,6}})(?:\\D|$)', 1), '') AS INTEGER) AS file_order FROM {DOCS}""")
def document_ids(spark, d):
    return read(spark, d, "casefile_documents").select("case_doc_id", T.document_id(F.col("relative_path")).alias("id"), T.leading_number(F.col("filename")).alias("file_order"))


@query("path_parts", f"""SELECT case_doc_id, regexp_extract(relative_path, '[^/]*$') AS name, regexp_replace(relative_path, '/?[^/]*$', '') AS parent, lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '[^.](\\.[^.]+)$', 1)) AS ext, split_part(relative_path, '/', 1) AS top FROM {DOCS}""")
def path_parts(spark, d):
    p = F.col("relative_path")
    return read(spark, d, "casefile_documents").select("case_doc_id", T.basename(p).alias("name"), T.parent(p).alias("parent"), T.suffix(T.basename(p)).alias("ext"), T.top_segment(p).alias("top"))


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(' ' || {column} || ' ', ' {p.replace(chr(39), chr(39) * 2)} ')" for p in phrases) + ")"


def _file_case(what: int) -> str:
    rows = ["WHEN name = 'COMPLETE' THEN '" + ("marker_tecnico", "high")[what] + "'"]
    for kind, confidence, phrases in rules.FILE_RULES:
        holds = _any("w", phrases)
        if phrases == ("verbale",):
            holds = f"({holds} OR ({_any('w', ('verb',))} AND {_any('w', ('ud',))}) OR (contains(w, 'verbale') AND contains(w, 'udienza')))"
        rows.append(f"WHEN {holds} THEN '{(kind, confidence)[what]}'")
    return "CASE " + " ".join(rows) + f" ELSE '{('sconosciuto', 'low')[what]}' END"


@query("filename_rules", f"""SELECT case_doc_id, {_file_case(0)} AS kind, {_file_case(1)} AS confidence FROM (SELECT case_doc_id, regexp_extract(relative_path, '[^/]*$') AS name,
  trim(regexp_replace({FOLD.format("regexp_replace(relative_path, '([^/.])\\.[^./]+$', '\\1')")}, '[^a-z0-9]+', ' ', 'g')) AS w FROM {DOCS})""")
def filename_rules(spark, d):
    return read(spark, d, "casefile_documents").select("case_doc_id", rules.file_type(F.col("relative_path")).alias("t")).select("case_doc_id", "t.kind", "t.confidence")


@query("unit_rollup", f"""SELECT casefile_id, unit_id, count(*) AS total_files, count(*) FILTER (ext = '.pdf') AS total_pdf_files, count(*) FILTER (ext <> '.pdf') AS total_non_pdf_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
  arg_min(relative_path, (scan_ord, case_doc_id)) FILTER (relative_path = unit_id || '/' || unit_id || '.pdf') AS main_pdf_path, arg_min(relative_path, (scan_ord, case_doc_id)) FILTER (name = 'ListaAllegati.html') AS attachment_index_path,
  arg_min(relative_path, (scan_ord, case_doc_id)) FILTER (name = 'COMPLETE') AS complete_marker_path
  FROM (SELECT *, split_part(relative_path, '/', 1) AS unit_id, regexp_extract(relative_path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '[^.](\\.[^.]+)$', 1)) AS ext FROM {DOCS} WHERE regexp_matches(relative_path, '^\\d+/'))
  GROUP BY ALL HAVING count(*) FILTER (ext = '.pdf') > 0""")
def unit_rollup(spark, d):
    return C.build_units(read(spark, d, "casefile_documents"))


@query("unit_main_hash", f"""SELECT u.casefile_id, u.unit_id, u.main_pdf_path, d.sha256 FROM {UNITS} u LEFT JOIN {DOCS} d ON d.casefile_id = u.casefile_id AND d.relative_path = u.main_pdf_path""")
def unit_main_hash(spark, d):
    return C.unit_hashes(read(spark, d, "casefile_units"), read(spark, d, "casefile_documents"))


@query("case_profile", f"""WITH f AS (SELECT casefile_id, count(*) AS total, count(*) FILTER (lower(extension) = '.pdf') AS n_pdf, count(*) FILTER (lower(extension) IN ('.tif', '.tiff', '.jpg', '.jpeg', '.png', '.bmp', '.gif')) AS n_images, count(*) FILTER (filename = 'ListaAllegati.html') AS n_indexes FROM {DOCS} GROUP BY ALL),
  u AS (SELECT casefile_id, count(*) AS n_units, count(*) FILTER (attachment_index_path <> '') AS n_indexed FROM {UNITS} GROUP BY ALL), b AS (SELECT f.*, coalesce(u.n_units, 0) AS n_units, coalesce(u.n_indexed, 0) AS n_indexed FROM f LEFT JOIN u USING (casefile_id)),
  k AS (SELECT *, CASE WHEN n_units >= 2 AND n_indexes > 0 AND n_pdf >= 2 THEN 'ministeriale_tiap' WHEN (n_pdf > 0 AND n_images > 0) OR (n_units > 0 AND n_pdf + n_images < total) THEN 'misto' WHEN n_indexes = 0 AND n_images > 0 AND n_images / total >= 0.5 AND n_pdf <= n_images THEN 'immagini_scansioni'
    WHEN n_indexes = 0 AND n_units = 0 AND n_pdf > 0 AND n_pdf / total >= 0.5 THEN 'pdf_sciolti' ELSE 'sconosciuto' END AS profile, CAST(round_even(n_images / total * 100, 0) AS BIGINT) AS pi, CAST(round_even(n_pdf / total * 100, 0) AS BIGINT) AS pp FROM b)
  SELECT casefile_id, total, n_pdf, n_images, n_indexes, n_units, n_indexed, profile, CASE profile WHEN 'ministeriale_tiap' THEN 'high' WHEN 'misto' THEN 'medium' WHEN 'immagini_scansioni' THEN (CASE WHEN pi >= 80 THEN 'high' ELSE 'medium' END) WHEN 'pdf_sciolti' THEN (CASE WHEN pp >= 80 THEN 'high' ELSE 'medium' END) ELSE 'low' END AS confidence,
  CASE profile WHEN 'ministeriale_tiap' THEN 'rilevate ' || n_units || ' unità con ' || n_indexed || ' ListaAllegati.html e PDF principale numerico' WHEN 'misto' THEN n_pdf || ' PDF, ' || n_images || ' immagini, ' || n_units || ' unità TIAP su ' || total || ' file totali'
    WHEN 'immagini_scansioni' THEN n_images || '/' || total || ' file immagine (' || pi || '%), ' || n_pdf || ' PDF, nessun indice allegati' WHEN 'pdf_sciolti' THEN n_pdf || '/' || total || ' PDF (' || pp || '%), assenza struttura TIAP e indici allegati' ELSE total || ' file, nessun pattern strutturale riconosciuto' END AS reason FROM k""")
def case_profile(spark, d):
    return C.case_profile(read(spark, d, "casefile_documents"), read(spark, d, "casefile_units"))


@query("case_counts", f"""SELECT casefile_id, count(*) AS n_files, count(*) FILTER (lower(extension) = '.pdf') AS n_pdf, count(*) FILTER (sha256 IS NULL) AS n_unhashed, count(DISTINCT sha256) AS n_contents, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, min(scanned_at) AS first_scan, max(scanned_at) AS last_scan FROM {DOCS} GROUP BY ALL""")
def case_counts(spark, d):
    return read(spark, d, "casefile_documents").groupBy("casefile_id").agg(
        F.count("*").alias("n_files"), F.count_if(F.lower("extension") == ".pdf").alias("n_pdf"), F.count_if(F.col("sha256").isNull()).alias("n_unhashed"), F.countDistinct("sha256").alias("n_contents"),
        F.sum("size_bytes").alias("size_bytes"), F.min("scanned_at").alias("first_scan"), F.max("scanned_at").alias("last_scan"))


@query("largest_files", f"""SELECT casefile_id, r AS rank, case_doc_id, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY casefile_id ORDER BY size_bytes DESC, scan_ord, case_doc_id) AS r FROM {DOCS}) WHERE r <= 10""")
def largest_files(spark, d):
    return C.largest_files(read(spark, d, "casefile_documents"))


@query("path_order", f"""SELECT case_doc_id, row_number() OVER (PARTITION BY casefile_id ORDER BY lower(relative_path), relative_path) AS position FROM {DOCS}""")
def path_order(spark, d):
    docs = read(spark, d, "casefile_documents").select("case_doc_id", "casefile_id", "relative_path")
    # the first letters never fall along the order of paths
    first = F.conv(F.hex(F.substring(F.rpad(F.encode(F.lower("relative_path"), "UTF-8"), 6, F.lit(b"\x00")), 1, 6)), 16, 10).cast("long")
    return C.running(docs, ["casefile_id"], [F.lower("relative_path"), F.col("relative_path")], F.lit(1), "position", first).select("case_doc_id", "position")


@query("size_text", f"""SELECT case_doc_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', round_even(size_bytes / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MB', round_even(size_bytes / 1048576.0::DOUBLE, 1)) END AS size FROM {DOCS}""")
def size_text(spark, d):
    return read(spark, d, "casefile_documents").select("case_doc_id", T.human_size(F.col("size_bytes")).alias("size"))


@query("index_files", f"""SELECT * FROM (SELECT casefile_id, relative_path, CASE WHEN ext NOT IN ('.html', '.htm', '.xml', '.txt', '.csv') THEN NULL
  WHEN name = 'ListaAllegati.html' THEN CASE WHEN regexp_matches(relative_path, '(^|/)\\d+/[^/]*$') THEN 'high' ELSE 'medium' END
  WHEN ext IN ('.html', '.htm', '.xml') AND (contains(stem, 'indice') OR contains(stem, 'index')) THEN 'high' WHEN contains(stem, 'fascicolo') OR contains(stem, 'elenco') OR contains(stem, 'documenti') OR contains(stem, 'atti') THEN 'medium'
  WHEN contains(stem, 'indice') OR contains(stem, 'index') THEN 'low' END AS confidence, CASE WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext = '.xml' THEN 'xml' WHEN ext = '.txt' THEN 'text' WHEN ext = '.csv' THEN 'csv' ELSE 'unknown' END AS detected_format
  FROM (SELECT *, regexp_extract(relative_path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '[^.](\\.[^.]+)$', 1)) AS ext, lower(regexp_replace(regexp_extract(relative_path, '[^/]*$'), '([^.])\\.[^.]+$', '\\1')) AS stem FROM {DOCS})) WHERE confidence IS NOT NULL""")
def index_files(spark, d):
    return C.detect_indexes(read(spark, d, "casefile_documents"))


REF = r"trim(url_decode(regexp_replace(regexp_replace(replace(referenced_path, '\', '/'), '^[A-Za-z][A-Za-z0-9+.-]+:', ''), '[?#].*$', '')))"
CASCADE = f"""
  WITH e AS (SELECT entry_id, casefile_id, lower(ref) AS k1, lower(regexp_extract(ref, '[^/]*$')) AS k2, trim(regexp_replace({FOLD.format("regexp_extract(ref, '[^/]*$')")}, '[\\s_-]+', ' ', 'g')) AS k3 FROM
    (SELECT entry_id, casefile_id, CASE WHEN regexp_matches(referenced_path, '^[A-Za-z]:') THEN trim(url_decode(regexp_replace(replace(referenced_path, '\\', '/'), '[?#].*$', ''))) ELSE {REF} END AS ref FROM {ENTRIES})),
  d AS (SELECT casefile_id, case_doc_id, lower(relative_path) AS k1, lower(regexp_extract(relative_path, '[^/]*$')) AS k2, trim(regexp_replace({FOLD.format("regexp_extract(relative_path, '[^/]*$')")}, '[\\s_-]+', ' ', 'g')) AS k3 FROM {DOCS}),
  g1 AS (SELECT casefile_id, k1, count(*) AS n1, min(case_doc_id) AS d1 FROM d GROUP BY ALL), g2 AS (SELECT casefile_id, k2, count(*) AS n2, min(case_doc_id) AS d2 FROM d GROUP BY ALL), g3 AS (SELECT casefile_id, k3, count(*) AS n3, min(case_doc_id) AS d3 FROM d GROUP BY ALL),
  j AS (SELECT * FROM e LEFT JOIN g1 USING (casefile_id, k1) LEFT JOIN g2 USING (casefile_id, k2) LEFT JOIN g3 USING (casefile_id, k3)),
  s AS (SELECT entry_id, casefile_id, CASE WHEN k1 IS NULL THEN 'no_reference' WHEN n1 = 1 THEN 'relative_path_exact' WHEN n1 > 1 THEN 'ambiguous' WHEN n2 = 1 THEN 'basename_exact' WHEN n2 > 1 THEN 'ambiguous' WHEN n3 = 1 THEN 'normalized_basename' WHEN n3 > 1 THEN 'ambiguous' ELSE 'unmatched' END AS strategy, coalesce(d1, d2, d3) AS doc FROM j),
  m AS (SELECT entry_id, casefile_id, strategy, CASE WHEN strategy IN ('relative_path_exact', 'basename_exact') THEN 'high' WHEN strategy = 'normalized_basename' THEN 'medium' END AS confidence, CASE WHEN strategy NOT IN ('no_reference', 'ambiguous', 'unmatched') THEN doc END AS case_doc_id FROM s)"""


@query("match_cascade", CASCADE + " SELECT * FROM m")
def match_cascade(spark, d):
    return C.match_entries(read(spark, d, "index_entries"), read(spark, d, "casefile_documents"))


@query("match_coverage", CASCADE + " SELECT casefile_id, count(*) AS n_entries, count(case_doc_id) AS n_matched, count(*) FILTER (strategy = 'ambiguous') AS n_ambiguous, count(case_doc_id) / count(*) AS coverage FROM m GROUP BY ALL")
def match_coverage(spark, d):
    m = match_cascade(spark, d)
    return m.groupBy("casefile_id").agg(F.count("*").alias("n_entries"), F.count("case_doc_id").alias("n_matched"), F.count_if(F.col("strategy") == "ambiguous").alias("n_ambiguous"), (F.count("case_doc_id") / F.count("*")).alias("coverage"))


@query("entry_fields", f"""SELECT entry_id, nullif(regexp_extract(label, '\\b(\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), '') AS first_date, nullif(trim(regexp_extract(referenced_path, '(?i)(\\S+\\.pdf)', 1), '"''()[]{{}}<>,;:'), '') AS first_pdf,
  CASE WHEN length(label) <= 40 THEN label ELSE left(label, 37) || '...' END AS short_label, nullif(trim(regexp_replace(label, '\\s+', ' ', 'g')), '') AS clean_label FROM {ENTRIES}""")
def entry_fields(spark, d):
    label = F.col("label")
    return read(spark, d, "index_entries").select("entry_id", T.first_date(label).alias("first_date"), T.first_pdf(F.col("referenced_path")).alias("first_pdf"), T.shorten(label, 40).alias("short_label"), T.null_if_empty(T.squeeze(label)).alias("clean_label"))


@query("entry_safe_reference", f"""SELECT entry_id, CASE WHEN outside OR list_contains(string_split(regexp_replace(ref, '^\\./', ''), '/'), '..') THEN nullif(regexp_extract(ref, '([^/]*)/*$', 1), '') ELSE nullif(regexp_replace(ref, '^\\./', ''), '') END AS safe_reference FROM
  (SELECT entry_id, regexp_matches(referenced_path, '^\\s*[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(replace(referenced_path, '\\', '/'), '^/') AS outside,
   CASE WHEN regexp_matches(referenced_path, '^[A-Za-z]:') THEN trim(url_decode(replace(referenced_path, '\\', '/'))) ELSE {REF} END AS ref FROM {ENTRIES})""")
def entry_safe_reference(spark, d):
    return read(spark, d, "index_entries").select("entry_id", T.safe_reference(F.col("referenced_path")).alias("safe_reference"))


@query("entry_numbering", f"""SELECT entry_id, row_number() OVER (PARTITION BY casefile_id, index_path ORDER BY row_number, entry_id) AS kept_number FROM {ENTRIES} WHERE referenced_path IS NOT NULL OR length(coalesce(label, '')) >= 4""")
def entry_numbering(spark, d):
    from pyspark.sql import Window

    kept = read(spark, d, "index_entries").where("referenced_path is not null or length(coalesce(label, '')) >= 4")
    return kept.select("entry_id", F.row_number().over(Window.partitionBy("casefile_id", "index_path").orderBy("row_number", "entry_id")).cast("long").alias("kept_number"))


DAY = """CASE WHEN regexp_matches(trim(index_date), '^\\d{2}/\\d{2}/\\d{4}$') THEN [CAST(substr(trim(index_date), 7, 4) AS INT), CAST(substr(trim(index_date), 4, 2) AS INT), CAST(substr(trim(index_date), 1, 2) AS INT)]
  WHEN regexp_matches(trim(index_date), '^\\d{4}-\\d{2}-\\d{2}$') THEN [CAST(substr(trim(index_date), 1, 4) AS INT), CAST(substr(trim(index_date), 6, 2) AS INT), CAST(substr(trim(index_date), 9, 2) AS INT)] ELSE [9999, 99, 99] END"""


@query("unit_order", f"""SELECT unit_key, casefile_id, row_number() OVER (PARTITION BY casefile_id ORDER BY coalesce(faldone_number, 0), day[1], day[2], day[3], coalesce(pg_progressive, 999999), coalesce(TRY_CAST(unit_id AS BIGINT), 999999999), unit_key) AS suggested_order,
  kind AS order_source, CASE WHEN odd OR kind = 'unit_id' THEN 'low' ELSE 'high' END AS order_confidence, odd AS anomalous_date FROM (SELECT *, day[1] <> 9999 AND (day[1] < 1950 OR day[1] > 2099) AS odd,
  CASE WHEN faldone_number IS NOT NULL THEN 'faldone+data+pg+unit_id' WHEN day[1] <> 9999 THEN 'data+pg+unit_id' WHEN pg_progressive IS NOT NULL THEN 'pg+unit_id' ELSE 'unit_id' END AS kind FROM (SELECT *, {DAY} AS day FROM {UNITS}))""")
def unit_order(spark, d):
    return C.unit_order(read(spark, d, "casefile_units"))


def _act_case(what: int) -> str:
    rows = []
    for kind, confidence, phrases in rules.ACT_RULES:
        if (kind, confidence) in rules.PAIR_RULES:
            who, what_, alone = rules.PAIR_RULES[kind, confidence]
            holds = f"({_any('w', who)} AND {_any('w', what_)})" + (f" OR {_any('w', alone)}" if alone else "")
        else:
            holds = _any("w", phrases)
        rows.append(f"WHEN {holds} THEN '{(kind, confidence)[what]}'")
    return "CASE " + " ".join(rows) + f" ELSE '{('altro', 'low')[what]}' END"


WORDS = "trim(concat_ws(' ', " + ", ".join("trim(regexp_replace(" + FOLD.format(f"coalesce({c}, '')") + ", '[^a-z0-9'']+', ' ', 'g'))" for c in ("act_title", "description")) + "))"
ACTS = f"(SELECT unit_key, casefile_id, {_act_case(0)} AS category, {_act_case(1)} AS confidence FROM (SELECT *, {WORDS} AS w FROM {UNITS}))"


@query("act_rules", f"SELECT * FROM {ACTS}")
def act_rules(spark, d):
    c = rules.act_category(F.col("act_title"), F.col("description"))
    return read(spark, d, "casefile_units").select("unit_key", "casefile_id", c.alias("c")).select("unit_key", "casefile_id", F.col("c.kind").alias("category"), "c.confidence")


@query("act_histogram", f"SELECT category, count(*) AS n_units, count(DISTINCT casefile_id) AS n_cases FROM {ACTS} GROUP BY ALL ORDER BY n_units DESC, category")
def act_histogram(spark, d):
    return act_rules(spark, d).groupBy("category").agg(F.count("*").alias("n_units"), F.countDistinct("casefile_id").alias("n_cases")).orderBy(F.desc("n_units"), "category")


@query("unit_sort_group", f"SELECT unit_key, category, CASE category " + " ".join(f"WHEN '{c}' THEN '{g}'" for c, (g, _) in rules.SORT_GROUPS.items()) + " END AS sort_group, CAST(CASE category " + " ".join(f"WHEN '{c}' THEN {p}" for c, (_, p) in rules.SORT_GROUPS.items()) + " END AS INTEGER) AS sort_priority, CASE category " + " ".join(f"WHEN '{c}' THEN '{rules.GROUP_LABELS[g]}'" for c, (g, _) in rules.SORT_GROUPS.items()) + f" END AS label FROM {ACTS}")
def unit_sort_group(spark, d):
    return act_rules(spark, d).select("unit_key", "category", rules.sort_group(F.col("category")).alias("g")).select("unit_key", "category", "g.sort_group", "g.sort_priority", "g.label")


@query("unit_bookmarks", f"""SELECT unit_key, CASE WHEN length(t) <= 100 THEN t ELSE left(t, 97) || '...' END AS bookmark FROM (SELECT unit_key, coalesce(nullif(concat_ws(' - ', CASE WHEN length(act_number) >= 3 THEN act_number ELSE lpad(act_number, 3, '0') END, nullif(trim(act_title), '')), ''), 'Unità ' || unit_id) AS t FROM {UNITS})""")
def unit_bookmarks(spark, d):
    return read(spark, d, "casefile_units").select("unit_key", C.unit_bookmark(F.col("act_number"), F.col("act_title"), F.col("unit_id")).alias("bookmark"))


@query("unit_numbers", f"""SELECT unit_key, TRY_CAST(nullif(regexp_extract(faldone, '\\d+'), '') AS INTEGER) AS faldone_number, TRY_CAST(nullif(regexp_extract(pg_protocol, 'N\\s*\\d+/\\d+-(\\d+)/\\d{{4}}', 1), '') AS INTEGER) AS pg_progressive FROM {UNITS}""")
def unit_numbers(spark, d):
    return read(spark, d, "casefile_units").select("unit_key", F.regexp_extract("faldone", r"\d+", 0).try_cast("int").alias("faldone_number"), F.regexp_extract("pg_protocol", r"N\s*\d+/\d+-(\d+)/\d{4}", 1).try_cast("int").alias("pg_progressive"))


ORDERED = "ORDER BY final_order NULLS LAST, item_id"


@query("plan_renumber", f"""SELECT item_id, casefile_id, new_order, new_title, CASE WHEN new_order IS NOT NULL THEN (CASE WHEN length(CAST(new_order AS VARCHAR)) >= 3 THEN CAST(new_order AS VARCHAR) ELSE lpad(CAST(new_order AS VARCHAR), 3, '0') END) || ' - ' || new_title END AS new_label FROM
  (SELECT item_id, casefile_id, CASE WHEN include_in_merged_pdf THEN CAST(sum(CASE WHEN include_in_merged_pdf THEN 1 ELSE 0 END) OVER (PARTITION BY casefile_id {ORDERED} ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS new_order, CASE WHEN length(t) <= 100 THEN t ELSE rtrim(left(t, 97)) || '...' END AS new_title FROM
   (SELECT *, coalesce(nullif(trim(regexp_replace(trim(regexp_replace(coalesce(act_title, ''), '\\s+', ' ', 'g')), '^\\s*\\d+\\s*(?:[-–—.:)]\\s*)+', ''), ' -–—.:)'), ''), 'Unità ' || unit_id) AS t FROM {ITEMS}))""")
def plan_renumber(spark, d):
    return C.renumber_plan(read(spark, d, "merge_plan_items"))


@query("plan_offsets", f"""SELECT item_id, casefile_id, CAST(e - total_pages AS BIGINT) AS start_page, CAST(e - 1 AS BIGINT) AS end_page FROM (SELECT *, sum(total_pages) OVER (PARTITION BY casefile_id {ORDERED} ROWS UNBOUNDED PRECEDING) AS e FROM {ITEMS} WHERE include_in_merged_pdf AND total_pages > 0)""")
def plan_offsets(spark, d):
    return C.page_offsets(read(spark, d, "merge_plan_items"))


@query("plan_totals", f"""SELECT casefile_id, count(*) AS n_items, count(*) FILTER (include_in_merged_pdf) AS n_included, count(*) FILTER (NOT include_in_merged_pdf) AS n_excluded, CAST(sum(total_pages) FILTER (include_in_merged_pdf) AS BIGINT) AS known_pages,
  CASE WHEN count(*) FILTER (include_in_merged_pdf) = count(total_pages) FILTER (include_in_merged_pdf) THEN CAST(coalesce(sum(total_pages) FILTER (include_in_merged_pdf), 0) AS BIGINT) END AS estimated_pages, count(*) FILTER (len(warnings) > 0) AS n_warned FROM {ITEMS} GROUP BY ALL""")
def plan_totals(spark, d):
    return C.plan_totals(read(spark, d, "merge_plan_items"))


@query("plan_warnings", f"""SELECT item_id, casefile_id, n, w.code AS code, w.message AS message, CASE WHEN regexp_matches(w.path, '^(/|[A-Za-z][A-Za-z0-9+.-]*:)') OR contains(w.path, '..') THEN regexp_extract(w.path, '[^/]*$') ELSE nullif(regexp_replace(w.path, '^\\./', ''), '') END AS path FROM
  (SELECT item_id, casefile_id, unnest(range(1, len(warnings) + 1)) AS n, unnest(warnings) AS w FROM {ITEMS})""")
def plan_warnings(spark, d):
    return C.plan_warnings(read(spark, d, "merge_plan_items"))


@query("plan_excluded_reasons", f"""SELECT CASE WHEN exclude_reason IN ('duplicato', 'tecnico', 'irrilevante', 'escluso_manualmente') THEN exclude_reason WHEN exclude_reason IS NULL THEN 'senza motivo' ELSE 'nota libera' END AS reason, count(*) AS n_items FROM {ITEMS} WHERE NOT include_in_merged_pdf GROUP BY ALL""")
def plan_excluded_reasons(spark, d):
    r = F.col("exclude_reason")
    kind = F.when(r.isin("duplicato", "tecnico", "irrilevante", "escluso_manualmente"), r).when(r.isNull(), "senza motivo").otherwise("nota libera")
    return read(spark, d, "merge_plan_items").where("not include_in_merged_pdf").groupBy(kind.alias("reason")).agg(F.count("*").alias("n_items"))


@query("unit_page_blocks", f"""SELECT unit_key, CAST(s / 15 + 1 AS BIGINT) AS block_no, CAST(s + 1 AS BIGINT) AS first_page, CAST(least(s + 15, total_pages) AS BIGINT) AS last_page FROM (SELECT unit_key, total_pages, unnest(range(0, total_pages, 15)) AS s FROM {UNITS} WHERE total_pages > 0)""".replace("s / 15", "s // 15"))
def unit_page_blocks(spark, d):
    return C.tile_pages(read(spark, d, "casefile_units"), "unit_key", "total_pages", 15)


@query("plan_moved", f"""SELECT item_id, casefile_id, CASE WHEN casefile_id <> 'fasc-generale' THEN p WHEN p = 1 THEN 3 WHEN p <= 3 THEN p - 1 ELSE p END AS position FROM (SELECT item_id, casefile_id, row_number() OVER (PARTITION BY casefile_id {ORDERED}) AS p FROM {ITEMS})""")
def plan_moved(spark, d):
    return C.move_item(read(spark, d, "merge_plan_items"), "fasc-generale", 1, 3)
