"""Operators over small literal inputs that reach every branch, each with the rows they must give. The test tables hold few or no such cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoglio.catalog import query
from spoglio.operators import audit as A
from spoglio.operators import casefile as C
from spoglio.operators import jobs as B
from spoglio.operators import judgments as J
from spoglio.operators import markdown as M


def _quoted(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"


def fixture(name: str, columns: str, *rows: tuple):
    """The query `name` must give exactly these rows."""
    return query(name, f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) t({columns})")


def _texts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "k int, markdown string")


def _as_bigint(df, *names):
    return df.select(*[F.col(c).cast("int").alias(c) if c in names else F.col(c) for c in df.columns])


@fixture(
    "fixture_bookmarks", "k, strategy, position, title, page",
    (1, "markdown_headings", 1, "CAPITOLO PRIMO", 1), (1, "markdown_headings", 2, "Articolo 2 - Disposizioni finali", 4), (2, "text_heuristics", 1, "CAPITOLO I - PRINCIPI GENERALI", 1), (2, "text_heuristics", 2, "ART. 7 - Entrata in vigore", 3),
    (3, "page_chunks", 1, "Pagine 1-3", 1), (3, "page_chunks", 2, "Pagine 4-6", 4), (4, "pdf_outline", 1, "Titolo nativo", 3),
)
def fixture_bookmarks(spark, d):
    df = _texts(
        spark, "<!-- Blocco 1: pagine originali 1-3 -->\n## Blocco 1 - Pagine 1-3\n# CAPITOLO PRIMO\n# CAPITOLO PRIMO\n<!-- Blocco 2: pagine originali 4-6 -->\n# CAPITOLO PRIMO\n### Articolo 2 - Disposizioni finali\n",
        "<!-- Blocco 1: pagine originali 1-2 -->\nCAPITOLO I - PRINCIPI GENERALI\nQuesta è una normale frase del corpo.\ndata:image/png;base64,AAAA\n<!-- Blocco 2: pagine originali 3-4 -->\nART. 7 - Entrata in vigore\n", "# Prima del segno\nniente\n<!-- Blocco 1: pagine originali 90-95 -->\n# Fuori", "<!-- Blocco 1: pagine originali 1-5 -->\n# Altro")
    native = spark.createDataFrame([(4, 1, "Titolo nativo", 3), (4, 2, "TITOLO nativo", 3), (4, 3, "Oltre", 7)], "k int, position int, title string, page int")
    return _as_bigint(M.bookmarks(df.withColumn("pages", F.lit(6)), "k", "pages", block=3, native=native), "position", "page")


@fixture("fixture_act_outline", "k, position, title, page, block", (1, 1, "VERBALE DI SEQUESTRO", 1, 1), (1, 2, "Richiesta di archiviazione", 4, 2), (1, 3, "Opposizione alla richiesta di archiviazione", 4, 2), (1, 4, "Oggetto: querela", 4, 2))
def fixture_act_outline(spark, d):
    text = "Verbale prima del segno\n<!-- Blocco 1: pagine originali 1-3 -->\n# VERBALE DI SEQUESTRO\nsi redige il presente verbale\nVERBALE DI SEQUESTR0\nINDICE\n## Blocco 2 - Pagine 4-6\n**Richiesta di archiviazione**\nOpposizione alla richiesta di archiviazione\nOggetto: querela\n| decreto |"
    return _as_bigint(M.act_outline(_texts(spark, text, None), "k"), "position")


@fixture("fixture_headings", "k, markdown, headings_added", (1, "## TITOLO PRIMO\n\nx\n\nTITOLO PRIMO", 1), (2, "```\n1. Oggetto\n\n```\n\n### 1. Oggetto\n\n### Art. 3 Norme", 2), (3, "## Titolo in testo\n\n| A | B |\n\nwww.x.example", 1))
def fixture_headings(spark, d):
    return M.add_headings(_texts(spark, "TITOLO PRIMO\n\nx\n\nTITOLO PRIMO", "```\n1. Oggetto\n\n```\n\n1. Oggetto\n\nArt. 3 Norme", "Titolo in testo\n\n| A | B |\n\nwww.x.example"))


@fixture("fixture_sanitized", "k, markdown, embedded_images_removed, long_base64_lines_removed", (1, f"x {M.IMAGE_PLACEHOLDER} y {M.IMAGE_PLACEHOLDER} z {M.IMAGE_PLACEHOLDER}", 3, 0), (2, f"a\n{M.IMAGE_PLACEHOLDER}\nb", 0, 1), (3, "piano", 0, 0))
def fixture_sanitized(spark, d):
    return M.sanitize(_texts(spark, "x ![a](data:image/png;base64,AAAA) y <img src='data:image/gif;base64,BB=='> z DATA:IMAGE/png;base64,CC", "a\n" + "A" * 90 + "\nb", "piano"), most=80)


@fixture(
    "fixture_judgments", "k, detected, authority, composition, judge, sentence_number, proceeding_number, day, motivation, deadline, deposit, outcome, keywords, missing, source",
    (1, True, "Tribunale di Padova", "monocratica", "Maria Rossi", "123/2026", "456/2025", "18 giugno 2026", "riservata", "90 giorni", "20 giugno 2026", "condanna", "condanna", "", "riga 1: Tribunale di Padova in composizione monocratica"),
    (2, True, "Tribunale di Padova", "collegiale", None, "1", None, None, "non rilevata", None, None, "ambiguo", "condanna, assolve", "giudice, numero procedimento, udienza / dispositivo, deposito, motivazione", "pagina 7, riga 2: Tribunale di Padova"), (3, False, *[None] * 10, "", "", None),
)
def fixture_judgments(spark, d):
    one = "# Tribunale di Padova in composizione monocratica\nil giudice dott.ssa Maria Rossi ha pronunciato\nSENTENZA n. 123/2026\nR.G. 456/2025\nudienza del 18 giugno 2026\nmotivazione riservata, entro novanta giorni\nP.Q.M.\ncondanna l'imputato\ndepositata il 20 giugno 2026"
    two = "<!-- Blocco 1: pagine originali 7-9 -->\nTribunale di Padova\ncollegiale\nsentenza n. 1\nP.Q.M.\nassolve Tizio\ncondanna Caio"
    j = J.judgment_fields(_texts(spark, one, two, "appunti vari"), "k")
    value = lambda c, name=None: F.col(f"{c}.value").alias(name or c)
    return j.select("k", "detected", value("authority"), value("composition"), value("judge"), value("sentence_number"), value("proceeding_number"), value("hearing_or_decision_date", "day"), value("motivation_type", "motivation"), value("motivation_deadline", "deadline"), value("deposit_date", "deposit"), value("outcome"),
                    F.array_join("dispositive_keywords", ", ").alias("keywords"), F.array_join("missing_fields", ", ").alias("missing"), F.col("authority.source").alias("source"))


@fixture("fixture_keywords", "phrase, keyword", ("è condannato", "condanna"), ("dichiara colpevole", "colpevole"), ("il fatto non sussiste", "fatto non sussiste"), ("non è previsto dalla legge", "fatto non previsto dalla legge come reato"), ("estinto il reato", "estinzione reato"), ("remissione della querela", "remissione querela"), ("art. 444 c.p.p.", "patteggiamento"), ("rigetta", "rigetta"))
def fixture_keywords(spark, d):
    df = spark.createDataFrame([(p,) for p in ("è condannato", "dichiara colpevole", "il fatto non sussiste", "non è previsto dalla legge", "estinto il reato", "remissione della querela", "art. 444 c.p.p.", "rigetta")], "phrase string")
    return df.select("phrase", J.keyword_kind(F.col("phrase")).alias("keyword"))


def _plan(spark):
    warned = [("anomala", "Data atto anomala", "x/y.html"), ("solo_codice", None, None), (None, None, None)]
    items = [
        (11, "a", 1, "1", "1/1.pdf", True, None, "Uno", "001 - Uno", 3, None), (12, "a", 1, "2", "./2/2.pdf", None, None, "Due", None, 0, warned), (13, "a", None, "3", "3/3.pdf", True, None, " ", None, None, None), (14, "a", 3, "4", "../x.pdf", True, None, "Q", None, 2, None),
        (15, "a", 4, "5", "5/5.doc", True, None, "C", None, 2, None), (16, "a", 5, "6", " ", True, None, "S", None, 2, None), (17, "a", None, "7", "7/7.pdf", False, "  doppione ", "S", None, 2, None), (18, "a", 6, "8", "8/8.pdf", True, None, "S", None, 2, None),
        (21, "b", None, "1", "1/1.pdf", False, None, "S", None, 2, None), (31, "c", 2, "1", "1/1.pdf", True, None, "S", None, 2, None), (32, "c", 5, "2", "1/1.pdf", True, None, "S", None, 2, None), (33, "c", 7, "3", "C:/x.pdf", False, "", "S", None, 2, None),
    ]
    schema = "item_id long, casefile_id string, final_order int, unit_id string, source_pdf string, include_in_merged_pdf boolean, exclude_reason string, bookmark_title string, bookmark_label string, total_pages int, warnings array<struct<code: string, message: string, path: string>>"
    docs = spark.createDataFrame([(1, "a", "1/1.pdf", 2048), (2, "a", "2/2.pdf", 0), (3, "a", "3/3.pdf", 1280), (4, "a", "5/5.doc", 5), (5, "b", "1/1.pdf", 7), (6, "c", "1/1.pdf", 11_000_000)], "case_doc_id long, casefile_id string, relative_path string, size_bytes long")
    return spark.createDataFrame(items, schema), docs


@fixture(
    "fixture_plan_findings", "casefile_id, severity, item, message",
    ("a", "warning", 2, "Item 2: PDF sorgente vuoto: ./2/2.pdf."), ("a", "warning", 2, "Item 2: numero pagine mancante o zero."), ("a", "warning", 2, "Item 2: warning già presente nel piano: Data atto anomala"), ("a", "warning", 2, "Item 2: warning già presente nel piano: solo_codice"),
    ("a", "warning", 2, "Item 2: warning già presente nel piano: warning 3"), ("a", "warning", 3, "Item 3: ordine mancante."), ("a", "warning", 3, "Item 3: bookmark/titolo vuoto."), ("a", "warning", 3, "Item 3: numero pagine mancante o zero."),
    ("a", "error", 4, "Item 4: Il PDF sorgente deve essere un path relativo sicuro."), ("a", "error", 5, "Item 5: Il file sorgente non è un PDF: 5/5.doc"), ("a", "error", 6, "Item 6 incluso senza PDF sorgente."), ("a", "warning", 7, "Item 7 escluso dal PDF unico: doppione."),
    ("a", "error", 8, "Item 8: PDF sorgente non trovato: 8/8.pdf"), ("a", "error", None, "Ordine duplicato tra item inclusi: 1."), ("b", "warning", 1, "Item 1 escluso dal PDF unico: escluso."), ("b", "error", None, "Il merge plan non contiene PDF inclusi: Nessun item incluso nel PDF unico."),
    ("c", "warning", 3, "Item 3 escluso dal PDF unico: escluso."), ("c", "warning", None, "PDF sorgente duplicato tra item inclusi: 1/1.pdf."), ("c", "warning", None, "Ordine non sequenziale tra item inclusi: attesi valori 1..2."),
)
def fixture_plan_findings(spark, d):
    return _as_bigint(A.validate_plan(*_plan(spark)), "item")


@fixture("fixture_plan_validation", "casefile_id, ok, total_items, included_items, excluded_items, n_errors, n_warnings", ("a", False, 8, 7, 1, 5, 9), ("b", False, 1, 0, 1, 1, 1), ("c", True, 3, 2, 1, 0, 3))
def fixture_plan_validation(spark, d):
    items, docs = _plan(spark)
    return _as_bigint(A.validation_summary(items, A.validate_plan(items, docs)), "total_items", "included_items", "excluded_items", "n_errors", "n_warnings")


@fixture(
    "fixture_estimate", "casefile_id, item_id, pages, size, warning, reason", ("a", 11, 3, "2.0 KB", "", None), ("a", 12, 0, "0 B", "anomala: Data atto anomala | solo_codice | warning", None), ("a", 13, None, "1.2 KB", "", None), ("a", 14, 2, "non disponibile", "", None), ("a", 15, 2, "non disponibile", "", None), ("a", 16, 2, "non disponibile", "", None),
    ("a", 17, None, None, "", "doppione"), ("a", 18, 2, "non disponibile", "", None), ("b", 21, None, None, "", "escluso"), ("c", 31, 2, "10 MB", "", None), ("c", 32, 2, "10 MB", "", None), ("c", 33, None, None, "", "escluso"),
)
def fixture_estimate(spark, d):
    return _as_bigint(A.estimate_items(*_plan(spark)), "item_id").select("casefile_id", "item_id", "pages", "size", "warning", "reason")


@fixture("fixture_plan_warnings", "item_id, n, code, message, path", (12, 1, "anomala", "Data atto anomala", "x/y.html"), (12, 2, "solo_codice", None, None), (12, 3, None, None, None))
def fixture_plan_warnings(spark, d):
    return _as_bigint(C.plan_warnings(_plan(spark)[0]), "item_id", "n").drop("casefile_id")


@fixture(
    "fixture_profiles", "casefile_id, profile, confidence, reason", ("foto", "immagini_scansioni", "high", "5/6 file immagine (83%), 0 PDF, nessun indice allegati"), ("misto", "misto", "medium", "1 PDF, 1 immagini, 0 unità TIAP su 2 file totali"), ("pdf", "pdf_sciolti", "medium", "3/4 PDF (75%), assenza struttura TIAP e indici allegati"),
    ("testi", "sconosciuto", "low", "2 file, nessun pattern strutturale riconosciuto"), ("tiap", "ministeriale_tiap", "high", "rilevate 2 unità con 1 ListaAllegati.html e PDF principale numerico"), ("unita", "misto", "medium", "1 PDF, 0 immagini, 1 unità TIAP su 2 file totali"),
)
def fixture_profiles(spark, d):
    names = {"foto": "a.tif b.TIFF c.jpg d.gif e.png f.txt", "misto": "a.pdf b.bmp", "pdf": "a.pdf b.PDF c.pdf d.webp", "testi": "a.txt b.md", "tiap": "1.pdf 2.pdf ListaAllegati.html", "unita": "1.pdf n.txt"}
    docs = [(case, n, n[n.rindex(".") :]) for case, ns in names.items() for n in ns.split()]
    units = spark.createDataFrame([("tiap", "1/ListaAllegati.html"), ("tiap", None), ("unita", "")], "casefile_id string, attachment_index_path string")
    return C.case_profile(spark.createDataFrame(docs, "casefile_id string, filename string, extension string"), units).select("casefile_id", "profile", "confidence", "reason")


@fixture("fixture_bytes", "n, size", (None, "non disponibile"), (0, "0 B"), (1023, "1023 B"), (1280, "1.2 KB"), (10240, "10 KB"), (1048576, "1.0 MB"), (1610612736, "1.5 GB"), (5497558138880, "5.0 TB"))
def fixture_bytes(spark, d):
    return spark.createDataFrame([(n,) for n in (None, 0, 1023, 1280, 10240, 1048576, 1610612736, 5497558138880)], "n long").select("n", A.format_bytes(F.col("n")).alias("size"))


@fixture("fixture_messages", "k, message", (1, "errore in atto.pdf: non letto"), (2, "vedi dati.csv e x.pdf"), (3, "a b"))
def fixture_messages(spark, d):
    return _texts(spark, "errore in  /home/u/casi/atto.pdf: non letto", "vedi C:\\tmp\\dati.csv e ../../x.pdf", " a\n b ").select("k", A.warning_message(F.col("markdown")).alias("message"))


@fixture("fixture_durations", "seconds, text", (-3, "0s"), (59, "59s"), (61, "1m 01s"), (3725, "1h 02m 05s"), (360000, "100h 00m 00s"))
def fixture_durations(spark, d):
    return spark.createDataFrame([(n,) for n in (-3, 59, 61, 3725, 360000)], "seconds int").select("seconds", B.duration_text(F.col("seconds")).alias("text"))


def _blocks(spark):
    return spark.createDataFrame([(1, 1, 5, 10.0, 12), (1, 2, 5, 30.0, 12), (1, 3, 2, 8.0, 12), (2, 1, 4, 0.0, 4), (2, 2, 0, 0.0, 4)], "job int, block_no int, pages int, seconds double, total_pages int")


@fixture("fixture_progress", "job, block_no, percent, eta", (1, 1, 42, "14s"), (1, 2, 83, "8s"), (1, 3, 100, "0s"), (2, 1, 100, "0s"), (2, 2, 100, "0s"))
def fixture_progress(spark, d):
    return B.block_progress(_blocks(spark), "job").select("job", "block_no", "percent", "eta")


@query("fixture_slowest", "SELECT * FROM (VALUES (1, 2, 30.0::DOUBLE, 8.0::DOUBLE, 16.0::DOUBLE, 15.0::DOUBLE), (2, 1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)) t(job, block_no, slowest, fastest, mean, pages_per_minute)")
def fixture_slowest(spark, d):
    return B.slowest_block(_blocks(spark), "job")


@query("fixture_reduction", "SELECT * FROM (VALUES (1000, 750, 25.0::DOUBLE), (3, 1, 66.7::DOUBLE), (0, 5, NULL), (10, 12, -20.0::DOUBLE)) t(before, after, percent)")
def fixture_reduction(spark, d):
    return spark.createDataFrame([(1000, 750), (3, 1), (0, 5), (10, 12)], "before int, after int").select("*", B.size_reduction(F.col("before"), F.col("after")).alias("percent"))


@fixture("fixture_free_names", "name, free", ("o/a_searchable.pdf", "o/a_searchable_3.pdf"), ("o/b_searchable.pdf", "o/b_searchable.pdf"), ("o/c_searchable.pdf", "o/c_searchable_2.pdf"))
def fixture_free_names(spark, d):
    taken = spark.createDataFrame([("o/a_searchable.pdf",), ("o/a_searchable_2.pdf",), ("o/a_searchable_4.pdf",), ("o/b_searchable_2.pdf",), ("o/c_searchable.pdf",)], "path string")
    return B.first_free(spark.createDataFrame([("o/a_searchable.pdf",), ("o/b_searchable.pdf",), ("o/c_searchable.pdf",)], "name string"), "name", taken, "path", before=".pdf")


def _manifests(spark):
    out = "struct<markdown: string, index_markdown: string, searchable_pdf: string, run_log: string, manifest: string>"
    rows = [("m1", ("success",), (True,), ("a.md", None, "a.pdf", "run.log", "m.json")), ("m2", ("success",), (True,), (None, None, " ", None, None)), ("m3", ("running",), (False,), ("b.md", None, None, "x.log", None)), ("m4", None, None, None)]
    return spark.createDataFrame(rows, f"manifest_file string, job struct<status: string>, processing struct<ocr_searchable_pdf_requested: boolean>, outputs {out}")


@fixture(
    "fixture_verification", "manifest_file, ok, present, required, summary", ("m1", True, 3, 3, "Output verificati: 3/3\nWarning: Indice Markdown del PDF ricercabile non presente"),
    ("m2", False, 0, 3, "Output verificati: 0/3\nManca: markdown, run_log, manifest\nWarning: PDF ricercabile richiesto ma non presente"), ("m3", False, 0, 1, "Output verificati: 0/1\nManca: run_log"), ("m4", True, 0, 0, "Output verificati: 0/0"),
)
def fixture_verification(spark, d):
    m, listing = _manifests(spark), spark.createDataFrame([("a.md", 3), ("a.pdf", 0), ("run.log", 1), ("m.json", 9), ("m.json", 9)], "path string, size_bytes long")
    return _as_bigint(B.verification_summary(m, B.verify_outputs(m, listing)), "present", "required").select("manifest_file", "ok", "present", "required", "summary")


@fixture("fixture_manifests", "id, filename, status, run_log, reason, strategy", ("7", "atto uno.pdf", "running", "out/run.log", None, "conservative_heading_detection"), ("8", "b.pdf", "running", "o/run.log", "searchable_pdf_not_requested", None))
def fixture_manifests(spark, d):
    jobs = spark.createDataFrame([(7, "in/atto uno.pdf", "out", 5, "ab", "Bilanciato", 15, True, True, "ita", "auto", 1800), (8, "b.pdf", "o", None, None, "x", 10, False, None, "ita", "auto", None)], "job_id int, path string, output_dir string, size_bytes long, sha256 string, profile string, block_size int, structure_markdown boolean, searchable boolean, language string, backend string, timeout_seconds int")
    m = B.build_manifests(jobs.withColumn("started_at", F.lit("2026-01-01T00:00:00Z")))
    return m.select("job.id", "input.filename", "job.status", "outputs.run_log", "bookmarks.reason", F.col("markdown_structure.strategy").alias("strategy"))


@fixture("fixture_layout", "markdown, index_markdown, searchable_pdf, run_log, manifest", ("o/atto.v1_ocr.md", "o/atto.v1_ocr_index.md", "o/atto.v1_searchable.pdf", "o/run.log", "o/manifest.json"))
def fixture_layout(spark, d):
    return spark.createDataFrame([("in/atto.v1.pdf", "o")], "path string, folder string").select(B.output_names(F.col("path"), F.col("folder")).alias("n")).select("n.*")


@fixture("fixture_chosen_pdf", "output_dir, auto, light, original", ("a", "a/l.pdf", "a/l.pdf", "a/m.pdf"), ("b", "b/m.pdf", None, "b/m.pdf"), ("c", None, None, None))
def fixture_chosen_pdf(spark, d):
    out, listing = spark.createDataFrame([("a",), ("b",), ("c",)], "output_dir string"), spark.createDataFrame([("a/l.pdf",), ("a/m.pdf",), ("b/m.pdf",), ("c/x.pdf",)], "path string")
    for mode in ("auto", "light", "original"):
        out = B.chosen_pdf(out, listing, mode, "m.pdf", "l.pdf").withColumnRenamed("pdf", mode)
    return out


@fixture("fixture_orders", "relative_path, place, global", ("1/ListaAllegati.html", 1, False), ("B/indice.xml", 2, True), ("elenco.txt", 3, False), ("a/indice.csv", 4, False))
def fixture_orders(spark, d):
    from pyspark.sql import Window

    df = spark.createDataFrame([("1/ListaAllegati.html", "high"), ("B/indice.xml", "high"), ("a/indice.csv", "low"), ("elenco.txt", "medium")], "relative_path string, confidence string")
    place = F.row_number().over(Window.orderBy(B.index_rank(F.col("confidence")), F.lower("relative_path"), "relative_path"))
    sure = B.global_indexes(df).select("relative_path", F.lit(True).alias("global"))
    return df.select("relative_path", place.alias("place")).join(sure, "relative_path", "left").na.fill(False, ["global"])


@fixture("fixture_unit_ids", "unit_id, place", ("2", 1), ("010", 2), ("11", 3), ("bis", 4), ("x", 5))
def fixture_unit_ids(spark, d):
    from pyspark.sql import Window

    df = spark.createDataFrame([("11",), ("x",), ("010",), ("2",), ("bis",)], "unit_id string")
    return df.select("unit_id", F.row_number().over(Window.orderBy(B.unit_rank(F.col("unit_id")))).alias("place"))


@fixture("fixture_badges", "k, badge", (1, ""), (2, "uno"), (3, "3 avvisi: uno …"), (4, ""))
def fixture_badges(spark, d):
    return spark.createDataFrame([(1, []), (2, ["uno"]), (3, ["uno", "due", "tre"]), (4, None)], "k int, w array<string>").select("k", B.warning_badge(F.col("w")).alias("badge"))
