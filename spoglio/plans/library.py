"""Queries over Markdown texts and judgments, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoglio.catalog import query
from spoglio.functions import text as T
from spoglio.operators import judgments as J
from spoglio.operators import markdown as M
from spoglio.plans.casefile import FOLD, read, src
from spoglio.session import table

TEXTS, STRUCT = src("sanitize_results"), src("structure_results")
LINES = f"(SELECT job_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT job_id, string_split(markdown, chr(10)) AS l FROM {TEXTS} WHERE markdown IS NOT NULL))"


@query("line_relation", f"SELECT job_id, line_no, line FROM {LINES}")
def line_relation(spark, d):
    return M.lines(read(spark, d, "sanitize_results"), "job_id")


@query("page_of_line", f"SELECT job_id, line_no, last_value(TRY_CAST(nullif(regexp_extract(line, '(?i)\\bpag(?:ina)?\\.?\\s+(\\d+)\\b', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page FROM {LINES}")
def page_of_line(spark, d):
    pages = table(spark, d, "sanitize_results").where("markdown is not null").select("job_id", M.page_numbers(F.col("markdown")).alias("pages")).dropDuplicates(["job_id"])
    return pages.select("job_id", F.posexplode("pages").alias("pos", "page")).select("job_id", (F.col("pos") + 1).cast("long").alias("line_no"), "page")


@query("isolated_lines", f"SELECT job_id, line_no, line FROM (SELECT *, trim(lag(line, 1, '') OVER w) AS b, trim(lead(line, 1, '') OVER w) AS a FROM {LINES} WINDOW w AS (PARTITION BY job_id ORDER BY line_no)) WHERE trim(line) <> '' AND a = '' AND b = ''")
def isolated_lines(spark, d):
    alone = table(spark, d, "sanitize_results").where("markdown is not null").select("job_id", M.isolated_array(F.col("markdown")).alias("alone")).dropDuplicates(["job_id"])
    return alone.select("job_id", F.inline("alone"))


@query("uppercase_titles", f"SELECT job_id, line_no FROM {LINES} WHERE NOT regexp_matches(trim(line), '[.;,]$') AND len(regexp_split_to_array(trim(line), '\\s+')) BETWEEN 2 AND 16 AND len(regexp_extract_all(line, '\\p{{L}}')) >= 6 AND len(regexp_extract_all(line, '\\p{{Lu}}')) >= len(regexp_extract_all(line, '\\p{{L}}')) * 0.85")
def uppercase_titles(spark, d):
    return M.lines(read(spark, d, "sanitize_results"), "job_id").where(M.uppercase_title(F.col("line"))).select("job_id", "line_no")


@query("line_flags", f"SELECT job_id, line_no, regexp_matches(line, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{{2,}}') AS has_email, regexp_matches(line, '(?i)(https?://|www\\.)') AS has_url, regexp_matches(line, '\\b[0-9a-fA-F]{{24,}}\\b') AS has_hash, regexp_matches(line, '^#{{1,6}}\\s+\\S') AS is_heading FROM {LINES}")
def line_flags(spark, d):
    line = F.col("line")
    return M.lines(read(spark, d, "sanitize_results"), "job_id").select(
        "job_id", "line_no", line.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}").alias("has_email"), line.rlike(r"(?i)(https?://|www\.)").alias("has_url"), line.rlike(r"\b[0-9a-fA-F]{24,}\b").alias("has_hash"), line.rlike(r"^#{1,6}\s+\S").alias("is_heading"))


@query("fold_text", f"SELECT job_id, md5({FOLD.format('markdown')}) AS folded FROM {TEXTS} WHERE markdown IS NOT NULL")
def fold_text(spark, d):
    return read(spark, d, "sanitize_results").where("markdown is not null").select("job_id", F.md5(T.fold(F.col("markdown"))).alias("folded"))


URI = "data:image/[a-z0-9.+-]+(?:;[a-z0-9.+-]+=[^;,\\s]+)*;base64,[a-z0-9+/_=-]+"
IMAGE_FORMS = (f"(?i)!\\[[^\\r\\n]*?\\]\\(\\s*{URI}\\s*\\)", f"(?i)<img\\b[^>]*?\\bsrc\\s*=\\s*[\"'']{URI}[\"''][^>]*>", f"(?i){URI}")
CLEANED = f"(SELECT job_id, markdown AS t, 0 AS n FROM {TEXTS} WHERE markdown IS NOT NULL)"
for _form in IMAGE_FORMS:
    CLEANED = f"(SELECT job_id, regexp_replace(t, '{_form}', '{M.IMAGE_PLACEHOLDER}', 'g') AS t, n + len(regexp_extract_all(t, '{_form}')) AS n FROM {CLEANED})"


@query("sanitized", f"""SELECT job_id, md5(array_to_string([CASE WHEN length(l) > 20000 AND regexp_matches(l, '(?i)^[a-z0-9+/_=-]+$') THEN '{M.IMAGE_PLACEHOLDER}' ELSE l END FOR l IN string_split(t, chr(10))], chr(10))) AS digest, CAST(n AS INTEGER) AS embedded_images_removed,
  CAST(len([l FOR l IN string_split(t, chr(10)) IF length(l) > 20000 AND regexp_matches(l, '(?i)^[a-z0-9+/_=-]+$')]) AS INTEGER) AS long_base64_lines_removed FROM {CLEANED}""")
def sanitized(spark, d):
    return M.sanitize(table(spark, d, "sanitize_results").where("markdown is not null")).select("job_id", F.md5("markdown").alias("digest"), "embedded_images_removed", "long_base64_lines_removed").dropDuplicates(["job_id"])


@query("promoted_headings")
def promoted_headings(spark, d):
    return M.add_headings(table(spark, d, "sanitize_results")).select("job_id", F.md5("markdown").alias("digest"), "headings_added").dropDuplicates(["job_id"])


def _volumes(spark, d):
    """The texts of twenty jobs in a row of one folder merged into one, as the blocks of a scan are."""
    blocks = read(spark, d, "structure_results").withColumn("volume", F.expr("job_id div 20")).withColumn("block", F.expr("job_id % 20 + 1"))
    return M.merge_blocks(blocks.withColumn("key", F.concat_ws("/", "casefile_id", "volume")), "key", "block", "block", "block")


@query("act_outline")
def act_outline(spark, d):
    return M.act_outline(_volumes(spark, d), "key")


@query("bookmarks")
def bookmarks(spark, d):
    return M.bookmarks(_volumes(spark, d).withColumn("pages", F.lit(20)), "key", "pages")


@query("heading_counts", f"SELECT job_id, count(*) FILTER (regexp_matches(line, '^#{{1,6}}\\s+\\S')) AS n_headings, count(*) AS n_lines, count(*) FILTER (trim(line) = '') AS n_blank, max(length(line)) AS longest FROM (SELECT job_id, unnest(string_split(markdown, chr(10))) AS line FROM {STRUCT} WHERE markdown IS NOT NULL) GROUP BY ALL")
def heading_counts(spark, d):
    rel = M.lines(read(spark, d, "structure_results"), "job_id")
    return rel.groupBy("job_id").agg(F.count_if(F.col("line").rlike(r"^#{1,6}\s+\S")).alias("n_headings"), F.count("*").alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_blank"), F.max(F.length("line")).cast("long").alias("longest"))


@query("merged_texts", f"""SELECT casefile_id || '/' || (job_id // 20) AS key, md5(string_agg('<!-- Blocco ' || r || ': pagine originali ' || r || '-' || r || ' -->' || chr(10) || chr(10) || trim(coalesce(markdown, '')), chr(10) || chr(10) ORDER BY r)) AS digest, count(*) AS n_blocks
  FROM (SELECT *, job_id % 20 + 1 AS r FROM {STRUCT}) GROUP BY ALL""")
def merged_texts(spark, d):
    return _volumes(spark, d).select("key", F.md5("markdown").alias("digest"), "n_blocks")


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(line, '^\\s*#{1,6}\\s*', ''), '[*_`]+', '', 'g'), '\\s+', ' ', 'g'))"
SENT, PROC = J.SENTENCE.replace("(?iu)", "(?i)"), J.PROCEEDING.replace("(?iu)", "(?i)")


@query("judgment_numbers", f"""SELECT job_id, arg_min(regexp_extract(t, '{SENT}', 1), line_no) FILTER (regexp_matches(t, '{SENT}')) AS sentence_number, arg_min(regexp_extract(t, '{PROC}', 1), line_no) FILTER (regexp_matches(t, '{PROC}') AND NOT contains(lower(t), 'sentenza')) AS proceeding_number FROM (SELECT *, {CLEAN} AS t FROM {LINES}) GROUP BY ALL""")
def judgment_numbers(spark, d):
    t = J.clean_line(F.col("line"))
    rel = M.lines(read(spark, d, "sanitize_results"), "job_id").withColumn("t", t)
    s, p = T.first_match(F.col("t"), J.SENTENCE, 1), T.first_match(F.col("t"), J.PROCEEDING, 1)
    n = F.col("line_no")
    return rel.groupBy("job_id").agg(F.min_by(s, F.when(s.isNotNull(), n)).alias("sentence_number"), F.min_by(p, F.when(p.isNotNull() & ~F.lower("t").contains("sentenza"), n)).alias("proceeding_number"))


@query("judgment_fields")
def judgment_fields(spark, d):
    return J.judgment_fields(table(spark, d, "sanitize_results"), "job_id").dropDuplicates(["job_id"])


JUDGED = src("judgment_analyses")


@query("judgment_missing", "SELECT analysis_id, missing FROM (" + " UNION ALL ".join(f"SELECT analysis_id, '{label}' AS missing FROM {JUDGED} WHERE detected AND coalesce({c}.value, 'non rilevata') = 'non rilevata'" for c, label in {**J._LABELS, "motivation_type": "motivazione"}.items())
       + f" UNION ALL SELECT analysis_id, 'termine motivazione' FROM {JUDGED} WHERE detected AND motivation_type.value = 'riservata' AND motivation_deadline IS NULL)")
def judgment_missing(spark, d):
    return J.missing_fields(read(spark, d, "judgment_analyses"), "analysis_id")


def _shown(c: str) -> str:
    return f"coalesce(CASE WHEN {c}.confidence = 'high' THEN {c}.value ELSE {c}.value || ' (' || {c}.confidence || ')' END, 'non rilevato')"


@query("judgment_cards", f"""SELECT analysis_id, CASE WHEN detected THEN array_to_string(list_concat(['# Scheda sentenza', '', '## Dati provvedimento', '- Autorità giudiziaria: ' || {_shown('authority')}, '- Composizione: ' || {_shown('composition')}, '- Giudice: ' || {_shown('judge')},
  '- Numero sentenza: ' || {_shown('sentence_number')}, '- Numero procedimento: ' || {_shown('proceeding_number')}, '', '## Date rilevanti', '- Udienza / dispositivo: ' || {_shown('hearing_or_decision_date')}, '- Motivazione: ' || {_shown('motivation_type')},
  '- Termine motivazione: ' || {_shown('motivation_deadline')}, '- Deposito: ' || {_shown('deposit_date')}, '', '## Esito', '- Dispositivo: ' || {_shown('outcome')}, '- Parole chiave: ' || coalesce(nullif(array_to_string(dispositive_keywords, ', '), ''), 'non rilevate'), '', '## Alert impugnazione'],
  CASE WHEN len(warnings) > 0 THEN [('- ' || w) FOR w IN warnings] ELSE ['- Nessun alert euristico rilevato.'] END, ['- Dati mancanti da verificare: ' || coalesce(nullif(array_to_string(missing_fields, ', '), ''), 'nessuno tra i campi MVP')]), chr(10))
  ELSE '# Scheda sentenza' || chr(10) || chr(10) || 'Testo non riconosciuto come sentenza.' END AS card FROM {JUDGED}""")
def judgment_cards(spark, d):
    return J.card(read(spark, d, "judgment_analyses"), "analysis_id")


@query("judgment_alerts", f"""SELECT analysis_id, unnest(list_filter(['Parser euristico: non calcola termini di impugnazione e non sostituisce la verifica legale.', CASE WHEN deposit_date IS NULL THEN 'Data di deposito assente: verificare fascicolo e cancelleria prima di valutare scadenze.' END,
  CASE WHEN motivation_type.value = 'riservata' AND motivation_deadline IS NULL THEN 'Motivazione riservata senza termine rilevato: dato da controllare sul provvedimento originale.' END,
  CASE WHEN outcome.value = 'ambiguo' THEN 'Dispositivo con indicatori contrastanti o multipli: classificazione da verificare manualmente.' END], lambda x: x IS NOT NULL)) AS alert FROM {JUDGED} WHERE detected""")
def judgment_alerts(spark, d):
    return read(spark, d, "judgment_analyses").where("detected").select("analysis_id", F.explode(J.alerts()).alias("alert"))


@query("judgment_outcomes", f"SELECT coalesce(outcome.value, 'nessuno') AS outcome, outcome.confidence AS confidence, count(*) AS n FROM {JUDGED} WHERE detected GROUP BY ALL")
def judgment_outcomes(spark, d):
    return read(spark, d, "judgment_analyses").where("detected").groupBy(F.coalesce("outcome.value", F.lit("nessuno")).alias("outcome"), F.col("outcome.confidence").alias("confidence")).agg(F.count("*").alias("n"))


KIND = """CASE WHEN contains(k, 'condann') THEN 'condanna' WHEN contains(k, 'colpevole') THEN 'colpevole' WHEN contains(k, 'assolv') THEN 'assoluzione' WHEN contains(k, 'fatto non sussiste') THEN 'fatto non sussiste' WHEN contains(k, 'non costituisce reato') THEN 'non costituisce reato'
  WHEN contains(k, 'non aver commesso il fatto') THEN 'non aver commesso il fatto' WHEN contains(k, 'non') AND contains(k, 'previsto') AND contains(k, 'legge') THEN 'fatto non previsto dalla legge come reato' WHEN contains(k, 'prosciogl') THEN 'proscioglimento'
  WHEN contains(k, 'non doversi procedere') THEN 'non doversi procedere' WHEN contains(k, 'reato') AND (contains(k, 'estinzione') OR contains(k, 'estinto')) THEN 'estinzione reato' WHEN contains(k, 'prescrizione') THEN 'prescrizione' WHEN contains(k, 'remissione') AND contains(k, 'querela') THEN 'remissione querela'
  WHEN contains(k, 'difetto') AND contains(k, 'querela') THEN 'difetto di querela' WHEN contains(k, 'patteggiamento') OR contains(k, 'pena concordata') OR contains(k, 'pena su richiesta') OR (contains(k, 'art') AND contains(k, '444')) THEN 'patteggiamento' WHEN length(k) <= 40 THEN k ELSE rtrim(left(k, 37)) || '...' END"""


@query("judgment_keywords", f"""SELECT keyword, count(DISTINCT analysis_id) AS n_judgments FROM (SELECT analysis_id, {KIND} AS keyword FROM (SELECT analysis_id, lower(trim(regexp_replace(unnest(dispositive_keywords), '\\s+', ' ', 'g'), ' -–—:;,.')) AS k FROM {JUDGED}) WHERE k <> '') GROUP BY ALL""")
def judgment_keywords(spark, d):
    return J.keyword_counts(read(spark, d, "judgment_analyses"), "analysis_id")


@query("document_duplicates", "SELECT doc_id, first_doc FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first_doc")
def document_duplicates(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1"), "h").where("doc_id <> first_doc").select("doc_id", "first_doc")


@query("source_profile", "SELECT coalesce(source, '') AS source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (lang IS NULL) AS unlabelled, max(n_chars) AS longest FROM documents GROUP BY ALL")
def source_profile(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.count_if(F.col("lang").isNull()).alias("unlabelled"), F.max("n_chars").alias("longest"))
