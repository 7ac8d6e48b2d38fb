"""Queries over plans and case folders: findings, estimates, summaries; each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoglio.catalog import query
from spoglio.operators import audit as A
from spoglio.operators import casefile as C
from spoglio.plans.casefile import ACTS, CASCADE, DAY, DOCS, ENTRIES, ITEMS, UNITS, match_cascade, read

SRC = "trim(coalesce(source_pdf, ''))"
ROWS = f"""WITH raw AS (SELECT *, row_number() OVER (PARTITION BY casefile_id ORDER BY item_id) AS i, {SRC} AS src, replace({SRC}, '\\', '/') AS p, coalesce(include_in_merged_pdf, true) AS inc FROM {ITEMS}),
  have AS (SELECT casefile_id, relative_path, max(size_bytes) AS size_bytes FROM {DOCS} GROUP BY ALL),
  it AS (SELECT r.*, h.size_bytes AS found_size, CASE WHEN p = '' THEN NULL WHEN p LIKE '/%' OR list_contains(string_split(p, '/'), '..') OR substr(p, 2, 2) = ':/' THEN 'Il PDF sorgente deve essere un path relativo sicuro.'
    WHEN NOT lower(p) LIKE '%.pdf' THEN 'Il file sorgente non è un PDF: ' || p WHEN h.relative_path IS NULL THEN 'PDF sorgente non trovato: ' || p END AS fault FROM raw r LEFT JOIN have h ON h.casefile_id = r.casefile_id AND h.relative_path = regexp_replace(r.p, '^\\./', ''))"""
FINDINGS = ROWS + """, f AS (SELECT casefile_id, 'error' AS severity, i AS item, 'Item ' || i || ' incluso senza PDF sorgente.' AS message FROM it WHERE inc AND p = ''
  UNION ALL SELECT casefile_id, 'error', i, 'Item ' || i || ': ' || fault FROM it WHERE inc AND fault IS NOT NULL
  UNION ALL SELECT casefile_id, 'warning', i, 'Item ' || i || ' escluso dal PDF unico: ' || trim(coalesce(nullif(exclude_reason, ''), 'escluso')) || '.' FROM it WHERE NOT inc
  UNION ALL SELECT casefile_id, 'warning', i, 'Item ' || i || ': PDF sorgente vuoto: ' || src || '.' FROM it WHERE inc AND p <> '' AND fault IS NULL AND found_size = 0
  UNION ALL SELECT casefile_id, 'warning', i, 'Item ' || i || ': ordine mancante.' FROM it WHERE inc AND final_order IS NULL
  UNION ALL SELECT casefile_id, 'warning', i, 'Item ' || i || ': bookmark/titolo vuoto.' FROM it WHERE trim(coalesce(bookmark_label, '')) = '' AND trim(coalesce(bookmark_title, '')) = ''
  UNION ALL SELECT casefile_id, 'warning', i, 'Item ' || i || ': numero pagine mancante o zero.' FROM it WHERE coalesce(total_pages, 0) = 0
  UNION ALL SELECT casefile_id, 'warning', i, 'Item ' || i || ': warning già presente nel piano: ' || coalesce(nullif(trim(w.message), ''), nullif(trim(w.code), ''), 'warning ' || n) FROM (SELECT casefile_id, i, unnest(range(1, len(warnings) + 1)) AS n, unnest(warnings) AS w FROM it)
  UNION ALL SELECT casefile_id, 'error', NULL, 'Il merge plan non contiene PDF inclusi: Nessun item incluso nel PDF unico.' FROM it GROUP BY casefile_id HAVING count(*) FILTER (inc) = 0
  UNION ALL SELECT casefile_id, 'error', NULL, 'Ordine duplicato tra item inclusi: ' || final_order || '.' FROM it WHERE inc AND final_order IS NOT NULL GROUP BY casefile_id, final_order HAVING count(*) > 1
  UNION ALL SELECT casefile_id, 'warning', NULL, 'PDF sorgente duplicato tra item inclusi: ' || regexp_replace(replace(src, '\\', '/'), '^\\./', '') || '.' FROM it WHERE inc AND p <> '' AND fault IS NULL GROUP BY casefile_id, src HAVING count(*) > 1
  UNION ALL SELECT casefile_id, 'warning', NULL, 'Ordine non sequenziale tra item inclusi: attesi valori 1..' || count(*) || '.' FROM it WHERE inc AND final_order IS NOT NULL GROUP BY casefile_id HAVING count(*) = count(DISTINCT final_order) AND NOT (min(final_order) = 1 AND max(final_order) = count(*)))"""


def _plan(spark, d):
    return read(spark, d, "merge_plan_items"), read(spark, d, "casefile_documents")


@query("plan_findings", FINDINGS + " SELECT * FROM f")
def plan_findings(spark, d):
    return A.validate_plan(*_plan(spark, d))


@query("plan_validation", FINDINGS + """ SELECT t.casefile_id, coalesce(e, 0) = 0 AS ok, total_items, included_items, excluded_items, coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings FROM (SELECT casefile_id, count(*) AS total_items, count(*) FILTER (inc) AS included_items, count(*) FILTER (NOT inc) AS excluded_items FROM it GROUP BY ALL) t
  LEFT JOIN (SELECT casefile_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM f GROUP BY ALL) c USING (casefile_id)""")
def plan_validation(spark, d):
    items, docs = _plan(spark, d)
    return A.validation_summary(items, A.validate_plan(items, docs))


def _bytes(n: str) -> str:
    units = [f"WHEN {n} < {1024 ** (k + 1)} THEN (CASE WHEN {n} >= {10 * 1024**k} THEN printf('%.0f {u}', round_even({n} / {1024**k}::DOUBLE, 0)) ELSE printf('%.1f {u}', round_even({n} / {1024**k}::DOUBLE, 1)) END)" for k, u in ((1, "KB"), (2, "MB"), (3, "GB"))]
    return f"CASE WHEN {n} IS NULL THEN 'non disponibile' WHEN {n} < 1024 THEN {n} || ' B' {' '.join(units)} END"


ESTIMATE = ROWS + f""", e AS (SELECT casefile_id, item_id, CASE WHEN inc THEN final_order END AS "order", inc AS included, trim(coalesce(bookmark_label, '')) AS title, regexp_replace(p, '^\\./', '') AS source, CASE WHEN inc THEN total_pages END AS pages, CASE WHEN inc AND p <> '' AND fault IS NULL THEN found_size END AS size_bytes,
  coalesce(list_aggregate([coalesce(nullif(trim(w.code), ''), 'warning') || coalesce(': ' || nullif(trim(w.message), ''), '') FOR w IN warnings], 'string_agg', ' | '), '') AS warning, CASE WHEN NOT inc THEN trim(coalesce(nullif(exclude_reason, ''), 'escluso')) END AS reason, CAST(coalesce(len(warnings), 0) AS INTEGER) AS n_warnings FROM it)"""


@query("plan_estimate", ESTIMATE + f""" SELECT *, CASE WHEN included THEN {_bytes('size_bytes')} END AS size FROM e""")
def plan_estimate(spark, d):
    return A.estimate_items(*_plan(spark, d))


@query("plan_estimate_totals", ESTIMATE + f""", t AS (SELECT casefile_id, count(*) AS total_items, count(*) FILTER (included) AS included_items, count(*) FILTER (NOT included) AS excluded_items, CAST(coalesce(sum(pages), 0) AS BIGINT) AS estimated_pages, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS source_size_bytes,
  count(*) FILTER (included AND pages IS NULL) AS unknown, CAST(sum(n_warnings) AS BIGINT) AS n_warnings FROM e GROUP BY ALL) SELECT casefile_id, total_items, included_items, excluded_items, estimated_pages, source_size_bytes, {_bytes('source_size_bytes')} AS source_size, CASE WHEN unknown = 0 AND estimated_pages > 0 THEN source_size_bytes / estimated_pages END AS average_bytes_per_page, n_warnings FROM t""")
def plan_estimate_totals(spark, d):
    return A.estimate_totals(A.estimate_items(*_plan(spark, d)))


INDEXED = f"""(SELECT casefile_id FROM (SELECT *, regexp_extract(relative_path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '[^.](\\.[^.]+)$', 1)) AS ext, lower(regexp_replace(regexp_extract(relative_path, '[^/]*$'), '([^.])\\.[^.]+$', '\\1')) AS stem FROM {DOCS})
  WHERE ext IN ('.html', '.htm', '.xml', '.txt', '.csv') AND (name = 'ListaAllegati.html' OR contains(stem, 'indice') OR contains(stem, 'index') OR contains(stem, 'fascicolo') OR contains(stem, 'elenco') OR contains(stem, 'documenti') OR contains(stem, 'atti')))"""


@query("case_summary", CASCADE + f""", d0 AS (SELECT casefile_id, count(*) AS total_files, count(*) FILTER (lower(extension) = '.pdf') AS total_pdf_files, count(*) FILTER (lower(extension) <> '.pdf') AS total_non_pdf_files, count(*) FILTER (document_type = 'marker_tecnico') AS total_technical_files FROM {DOCS} GROUP BY ALL),
  n1 AS (SELECT casefile_id, count(*) AS total_indexes FROM {INDEXED} GROUP BY ALL), n2 AS (SELECT casefile_id, count(*) AS total_index_entries FROM {ENTRIES} GROUP BY ALL), n3 AS (SELECT casefile_id, count(*) AS total_index_matches FROM m WHERE case_doc_id IS NOT NULL GROUP BY ALL),
  n4 AS (SELECT casefile_id, count(*) AS total_units, count(*) FILTER (day[1] <> 9999 AND (day[1] < 1950 OR day[1] > 2099)) AS total_warnings FROM (SELECT *, {DAY} AS day FROM {UNITS}) GROUP BY ALL)
  SELECT casefile_id, total_files, total_pdf_files, total_non_pdf_files, coalesce(total_indexes, 0) AS total_indexes, coalesce(total_index_entries, 0) AS total_index_entries, coalesce(total_index_matches, 0) AS total_index_matches, coalesce(total_warnings, 0) AS total_warnings, coalesce(total_units, 0) AS total_units, total_technical_files
  FROM d0 LEFT JOIN n1 USING (casefile_id) LEFT JOIN n2 USING (casefile_id) LEFT JOIN n3 USING (casefile_id) LEFT JOIN n4 USING (casefile_id)""")
def case_summary(spark, d):
    docs, units = read(spark, d, "casefile_documents"), C.unit_order(read(spark, d, "casefile_units"))
    return A.summary(docs, C.detect_indexes(docs), read(spark, d, "index_entries"), match_cascade(spark, d), units)


@query("unit_table", f"""WITH o AS (SELECT unit_key, row_number() OVER (PARTITION BY casefile_id ORDER BY coalesce(faldone_number, 0), day[1], day[2], day[3], coalesce(pg_progressive, 999999), coalesce(TRY_CAST(unit_id AS BIGINT), 999999999), unit_key) AS n, day[1] <> 9999 AND (day[1] < 1950 OR day[1] > 2099) AS odd,
  CASE WHEN faldone_number IS NOT NULL THEN 'faldone+data+pg+unit_id' WHEN day[1] <> 9999 THEN 'data+pg+unit_id' WHEN pg_progressive IS NOT NULL THEN 'pg+unit_id' ELSE 'unit_id' END AS kind FROM (SELECT *, {DAY} AS day FROM {UNITS})), h AS (SELECT casefile_id, relative_path AS main_pdf_path, max(sha256) AS sha256 FROM {DOCS} GROUP BY ALL)
  SELECT u.casefile_id, u.unit_id, n AS suggested_order, concat_ws(' - ', nullif(act_number, ''), nullif(act_title, '')) AS act, category, coalesce(CAST(u.total_pages AS VARCHAR), '') AS pages, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', round_even(size_bytes / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MB', round_even(size_bytes / 1048576.0::DOUBLE, 1)) END AS size,
  coalesce(h.sha256, '') AS sha256, kind AS order_source, CASE WHEN odd OR kind = 'unit_id' THEN 'low' ELSE 'high' END AS order_confidence, CAST(odd AS INTEGER) AS n_warnings, CASE WHEN coalesce(complete_marker_path, '') <> '' THEN 'sì' ELSE '' END AS complete, CASE WHEN merge_candidate THEN 'sì' ELSE '' END AS included
  FROM {UNITS} u JOIN o USING (unit_key) JOIN {ACTS} a USING (unit_key) LEFT JOIN h ON h.casefile_id = u.casefile_id AND h.main_pdf_path = u.main_pdf_path""")
def unit_table(spark, d):
    from spoglio.functions import rules

    units = read(spark, d, "casefile_units")
    t = A.units_table(units, C.unit_order(units), read(spark, d, "casefile_documents"))
    back = F.create_map(*[F.lit(x) for kind, label in rules.CATEGORY_LABELS.items() for x in (label, kind)])
    col = lambda name: F.col(f"`{name}`")
    return t.select("casefile_id", col("ID unità").alias("unit_id"), col("Ordine suggerito").alias("suggested_order"), col("Atto").alias("act"), F.try_element_at(back, col("Categoria")).alias("category"), col("Tot. pagine").alias("pages"), col("Dimensione").alias("size"), col("SHA-256").alias("sha256"), col("Fonte ordine").alias("order_source"),
                    col("Confidenza ordine").alias("order_confidence"), col("Warning").alias("n_warnings"), col("COMPLETE").alias("complete"), col("Includi in PDF unico").alias("included"))


@query("top_metrics", f"""WITH k AS (SELECT casefile_id, coalesce(document_type, 'sconosciuto') AS kind, count(*) AS n FROM {DOCS} GROUP BY ALL), c AS (SELECT casefile_id, arg_max(kind, (n, kind)) AS commonest_type, max(n) AS n_commonest FROM k GROUP BY ALL)
  SELECT casefile_id, largest_doc, largest_size, commonest_type, n_commonest, pdf_share FROM (SELECT casefile_id, arg_max(case_doc_id, (size_bytes, -case_doc_id)) AS largest_doc, max(size_bytes) AS largest_size, count(*) FILTER (lower(extension) = '.pdf') / count(*) AS pdf_share FROM {DOCS} GROUP BY ALL) JOIN c USING (casefile_id)""")
def top_metrics(spark, d):
    return A.top_metrics(read(spark, d, "casefile_documents"))
