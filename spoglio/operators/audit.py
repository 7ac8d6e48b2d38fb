"""Checks, estimates and summaries of case folders and their merge plans, as rows: findings, items, roll-ups and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoglio.functions import rules
from spoglio.functions import text as T
from spoglio.operators.casefile import running


def report_path(path: Column) -> Column:
    """A path as a report shows it: slashes, no `./`, no doubled ones."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(T.slashes(F.trim(path)), r"/{2,}", "/"), r"(?:(?<=/)|^)\./", ""), r"/(?:\.)?$", "")


def source_fault(path: Column) -> Column:
    """Why a path can't be the source of a merged file, null if it can."""
    p = T.slashes(F.trim(F.coalesce(path, F.lit(""))))
    unsafe = (p == "") | p.startswith("/") | F.array_contains(F.split(p, "/"), "..") | (F.substring(p, 2, 2) == ":/")
    return F.when(unsafe, "Il PDF sorgente deve essere un path relativo sicuro.").when(T.suffix(F.regexp_extract(p, r"[^/]*$", 0)) != ".pdf", F.concat(F.lit("Il file sorgente non è un PDF: "), p))


def plan_rows(items: DataFrame, docs: DataFrame) -> DataFrame:
    """The items of each folder's plan with their number, the file they name and what is to be said of them: casefile_id, item_id, index, unit_id, source_pdf, included,
    final_order, bookmark_label, total_pages, exclude_reason, plan_warnings, size_bytes (null if the file isn't there), errors, warnings.

    A missing include flag counts as true. Blank sources and labels count as missing."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = running(items.withColumn("__one", F.lit(1)), ["casefile_id"], [F.col("item_id")], F.col("__one"), "index", F.floor(F.col("item_id") / 4096))
    carried = F.transform(F.coalesce("warnings", F.array().cast(items.schema["warnings"].dataType)), lambda w, n: F.coalesce(T.null_if_empty(F.trim(w["message"])), T.null_if_empty(F.trim(w["code"])), F.concat(F.lit("warning "), n + 1)))
    named = F.filter(F.transform(F.coalesce("warnings", F.array().cast(items.schema["warnings"].dataType)), lambda w: F.concat_ws(": ", F.coalesce(T.null_if_empty(F.trim(w["code"])), F.when(w["code"].isNull() | (w["code"] == ""), F.lit("warning"))), T.null_if_empty(F.trim(w["message"])))), lambda w: w != "")
    rows = rows.select(
        "casefile_id", "item_id", "index", blank("unit_id").alias("unit_id"), blank("source_pdf").alias("source"), F.coalesce("include_in_merged_pdf", F.lit(True)).alias("included"), "final_order", blank("bookmark_label").alias("bookmark_label"),
        blank("bookmark_title").alias("title"), "total_pages", F.trim(F.coalesce(T.null_if_empty(F.col("exclude_reason")), F.lit("escluso"))).alias("exclude_reason"), carried.alias("carried"), named.alias("plan_warnings"))
    have = docs.where("relative_path is not null").groupBy("casefile_id", F.col("relative_path").alias("at")).agg(F.max("size_bytes").alias("size_bytes"), F.lit(True).alias("there"))
    rows = rows.withColumn("at", report_path(F.col("source"))).join(have, ["casefile_id", "at"], "left")
    item = F.concat(F.lit("Item "), F.col("index"))
    fault = F.coalesce(source_fault(F.col("source")), F.when(F.col("there").isNull(), F.concat(F.lit("PDF sorgente non trovato: "), T.slashes(F.col("source")))))
    errors = F.array_compact(F.array(F.when(F.col("included") & (F.col("source") == ""), F.concat(item, F.lit(" incluso senza PDF sorgente."))).when(F.col("included") & fault.isNotNull(), F.concat(item, F.lit(": "), fault))))
    say = lambda holds, what: F.when(holds, F.concat(item, what))
    warnings = F.array_compact(F.array(
        say(~F.col("included"), F.concat(F.lit(" escluso dal PDF unico: "), F.col("exclude_reason"), F.lit("."))), say(F.col("included") & fault.isNull() & (F.col("size_bytes") == 0), F.concat(F.lit(": PDF sorgente vuoto: "), F.col("source"), F.lit("."))),
        say(F.col("included") & F.col("final_order").isNull(), F.lit(": ordine mancante.")), say((F.col("bookmark_label") == "") & (F.col("title") == ""), F.lit(": bookmark/titolo vuoto.")),
        say(F.coalesce(F.col("total_pages"), F.lit(0)) == 0, F.lit(": numero pagine mancante o zero."))))
    carried = F.transform("carried", lambda w: F.concat(item, F.lit(": warning già presente nel piano: "), w))
    return rows.select("casefile_id", "item_id", "index", "unit_id", F.col("at").alias("source_pdf"), "source", "included", "final_order", "bookmark_label", "total_pages", "exclude_reason", "plan_warnings", F.when(fault.isNull(), F.col("size_bytes")).alias("size_bytes"),
                       fault.isNull().alias("usable"), errors.alias("errors"), F.concat(warnings, carried).alias("warnings"))


def validate_plan(items: DataFrame, docs: DataFrame) -> DataFrame:
    """The findings of each folder's plan, one row each: casefile_id, severity, item (its number, null for the whole plan), message."""
    rows = plan_rows(items, docs)
    found = rows.select("casefile_id", F.col("index").alias("item"), F.explode(F.concat(F.transform("errors", lambda m: F.struct(F.lit("error").alias("severity"), m.alias("message"))), F.transform("warnings", lambda m: F.struct(F.lit("warning").alias("severity"), m.alias("message"))))).alias("f"))
    found = found.select("casefile_id", "f.severity", "item", "f.message")
    whole = lambda df, severity, message: df.select("casefile_id", F.lit(severity).alias("severity"), F.lit(None).cast("long").alias("item"), message.alias("message"))
    inc = rows.where("included")
    none = rows.groupBy("casefile_id").agg(F.count_if("included").alias("n")).where("n = 0")
    orders = inc.where("final_order is not null").groupBy("casefile_id", "final_order").agg(F.count("*").alias("n"))
    twice = orders.where("n > 1")
    # 1..n without gaps, if no order occurs twice
    run = orders.groupBy("casefile_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("final_order").alias("lo"), F.max("final_order").alias("hi")).where("most = 1 and not (lo = 1 and hi = n)")
    same = inc.where("usable").groupBy("casefile_id", "source").agg(F.count("*").alias("n"), F.first("source_pdf").alias("source_pdf")).where("n > 1")
    parts = [
        whole(none, "error", F.lit("Il merge plan non contiene PDF inclusi: Nessun item incluso nel PDF unico.")), whole(twice, "error", F.concat(F.lit("Ordine duplicato tra item inclusi: "), "final_order", F.lit("."))),
        whole(same, "warning", F.concat(F.lit("PDF sorgente duplicato tra item inclusi: "), "source_pdf", F.lit("."))), whole(run, "warning", F.concat(F.lit("Ordine non sequenziale tra item inclusi: attesi valori 1.."), "n", F.lit("."))),
    ]
    for p in parts:
        found = found.unionByName(p)
    return found


def validation_summary(items: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each folder with a plan: ok (no errors), total_items, included_items, excluded_items, n_errors, n_warnings."""
    included = F.coalesce("include_in_merged_pdf", F.lit(True))
    plans = items.groupBy("casefile_id").agg(F.count("*").alias("total_items"), F.count_if(included).alias("included_items"), F.count_if(~included).alias("excluded_items"))
    counts = findings.groupBy("casefile_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    out = plans.join(counts, "casefile_id", "left").na.fill(0, ["n_errors", "n_warnings"])
    return out.select("casefile_id", (F.col("n_errors") == 0).alias("ok"), "total_items", "included_items", "excluded_items", "n_errors", "n_warnings")


def format_bytes(n: Column) -> Column:
    """Binary units, one decimal below ten, ties to even; what is unknown is said to be."""
    size, text = F.greatest(n.cast("double"), F.lit(0.0)), F
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        x = size / 1024.0**k
        shown = F.format_string("%d B", F.floor(x)) if k == 0 else F.when(x >= 10, F.format_string(f"%.0f {unit}", F.bround(x, 0))).otherwise(F.format_string(f"%.1f {unit}", F.bround(x, 1)))
        text = text.when(x < 1024, shown) if unit != "TB" else text.otherwise(shown)
    return F.when(n.isNull(), "non disponibile").otherwise(text)


def estimate_items(items: DataFrame, docs: DataFrame) -> DataFrame:
    """What merging each folder's plan would take, one row for each item: order, included, title, source, pages, size_bytes, size, warning, reason. Excluded items have no order, pages and
    size. Pages are the plan's; a plan with errors is estimated all the same, its missing files without a size."""
    r = plan_rows(items, docs)
    inc = lambda c: F.when(F.col("included"), c)
    return r.select("casefile_id", "item_id", inc(F.col("final_order")).alias("order"), "included", F.col("bookmark_label").alias("title"), F.col("source_pdf").alias("source"), inc(F.col("total_pages")).alias("pages"), inc(F.col("size_bytes")).alias("size_bytes"),
                    inc(format_bytes(F.col("size_bytes"))).alias("size"), F.array_join("plan_warnings", " | ").alias("warning"), F.when(~F.col("included"), F.col("exclude_reason")).alias("reason"), F.size("plan_warnings").alias("n_warnings"))


def estimate_totals(estimated: DataFrame) -> DataFrame:
    """One row for each folder: total_items, included_items, excluded_items, estimated_pages, source_size_bytes, source_size, average_bytes_per_page (null unless all pages are known), n_warnings."""
    inc = F.col("included")
    out = estimated.groupBy("casefile_id").agg(
        F.count("*").alias("total_items"), F.count_if(inc).alias("included_items"), F.count_if(~inc).alias("excluded_items"), F.coalesce(F.sum(F.col("pages").cast("long")), F.lit(0)).alias("estimated_pages"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("source_size_bytes"), F.count_if(inc & F.col("pages").isNull()).alias("unknown"), F.sum("n_warnings").alias("n_warnings"))
    return out.select("casefile_id", "total_items", "included_items", "excluded_items", "estimated_pages", "source_size_bytes", format_bytes(F.col("source_size_bytes")).alias("source_size"),
                      F.when((F.col("unknown") == 0) & (F.col("estimated_pages") > 0), F.col("source_size_bytes") / F.col("estimated_pages")).alias("average_bytes_per_page"), "n_warnings")


def summary(docs: DataFrame, indexes: DataFrame, entries: DataFrame, matches: DataFrame, units: DataFrame) -> DataFrame:
    """The nine counters of each folder's analysis. indexes, entries, matches (with a case_doc_id where matched) and units by casefile_id."""
    pdf = F.lower("extension") == ".pdf"
    out = docs.groupBy("casefile_id").agg(F.count("*").alias("total_files"), F.count_if(pdf).alias("total_pdf_files"), F.count_if(~pdf).alias("total_non_pdf_files"), F.count_if(F.col("document_type") == "marker_tecnico").alias("total_technical_files"))
    for name, rows in (("total_indexes", indexes), ("total_index_entries", entries), ("total_index_matches", matches.where("case_doc_id is not null")), ("total_units", units)):
        out = out.join(rows.groupBy("casefile_id").agg(F.count("*").alias(name)), "casefile_id", "left")
    warned = units.groupBy("casefile_id").agg(F.count_if("anomalous_date").alias("total_warnings")) if "anomalous_date" in units.columns else units.groupBy("casefile_id").agg(F.lit(0).cast("long").alias("total_warnings"))
    out = out.join(warned, "casefile_id", "left")
    names = ["total_files", "total_pdf_files", "total_non_pdf_files", "total_indexes", "total_index_entries", "total_index_matches", "total_warnings", "total_units", "total_technical_files"]
    return out.na.fill(0).select("casefile_id", *names)


# The columns of the table of units.
UNIT_COLUMNS = ("#", "ID unità", "Atto", "Categoria", "Confidenza categoria", "Descrizione", "Data indice", "Faldone", "Tot. pagine", "Data inserimento", "Protocollo PG", "Progressivo PG", "Note", "Descrizione extra", "PDF principale", "Dimensione (byte)", "Dimensione",
                "ListaAllegati", "COMPLETE", "File totali", "PDF", "Non PDF", "Warning", "SHA-256", "Ordine suggerito", "Fonte ordine", "Confidenza ordine", "Segnalibro", "Gruppo ordinamento", "Priorità ordinamento", "Includi in PDF unico")


def units_table(units: DataFrame, order: DataFrame, docs: DataFrame) -> DataFrame:
    """casefile_id and the 31 columns of the table of units, in each folder's suggested order. units: as in the table of that name; order: unit_key, suggested_order, order_source,
    order_confidence, anomalous_date; docs: casefile_id, relative_path, sha256."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    act = F.array_join(F.array_compact(F.array(T.null_if_empty(F.col("act_number")), T.null_if_empty(F.col("act_title")))), " - ")
    found = rules.act_category(F.col("act_title"), F.col("description"))
    have = docs.where("relative_path is not null").groupBy("casefile_id", F.col("relative_path").alias("main_pdf_path")).agg(F.max("sha256").alias("sha256"))
    u = units.join(order.select("unit_key", "suggested_order", "order_source", "order_confidence", "anomalous_date"), "unit_key").join(have, ["casefile_id", "main_pdf_path"], "left").withColumn("c", found)
    u = u.withColumn("g", rules.sort_group(F.col("c.kind")))
    from spoglio.operators.casefile import unit_bookmark

    cells = [
        F.col("suggested_order"), F.col("unit_id"), act, rules.category_label(F.col("c.kind")), F.col("c.confidence"), text("description"), text("index_date"), text("faldone"), text("total_pages"), text("insertion_date"), text("pg_protocol"), text("pg_progressive"), text("notes"), F.lit(""),
        text("main_pdf_path"), F.col("size_bytes"), T.human_size(F.col("size_bytes")), text("attachment_index_path"), F.when(F.coalesce("complete_marker_path", F.lit("")) != "", "sì").otherwise(""), F.col("total_files"), F.col("total_pdf_files"), F.col("total_non_pdf_files"),
        F.col("anomalous_date").cast("int"), text("sha256"), F.col("suggested_order"), F.col("order_source"), F.col("order_confidence"), unit_bookmark(F.col("act_number"), F.col("act_title"), F.col("unit_id")), F.col("g.label"), F.col("g.sort_priority"), F.when(F.col("merge_candidate"), "sì").otherwise(""),
    ]
    return u.select("casefile_id", *[c.alias(name) for c, name in zip(cells, UNIT_COLUMNS)])


def warning_message(message: Column, most: int = 200) -> Column:
    """A warning as it may leave the machine: blanks collapsed, absolute paths and paths through `..` cut to their name, at most `most` characters."""
    bare = lambda w: F.regexp_replace(w, r"^[a-zA-Z]:(?=[\\/])", "")
    tail = r"([^\\/:;,)]*)[\\/]*([:;,)].*)?$"
    words = F.transform(F.split(T.squeeze(message), " "), lambda w: F.when(w.rlike(r"^(?:[a-zA-Z]:[\\/]|/)[^\s:;,)]"), F.concat(F.regexp_extract(bare(w), tail, 1), F.regexp_extract(bare(w), tail, 2))).when(w.rlike(r"\.\.[\\/]"), F.coalesce(T.basename(w), F.lit(""))).otherwise(w))
    return T.shorten(F.array_join(words, " "), most)


def numbered_list(rows: DataFrame, key: str, position: str, line: Column) -> DataFrame:
    """key, body: the lines of each key in the order of their position. A key is one document, whose list fits in a task."""
    return rows.select(key, F.struct(F.col(position).alias("p"), line.alias("l")).alias("x")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("body"))


def act_index(texts: DataFrame, outline: DataFrame, key: str, name: Column) -> DataFrame:
    """key, markdown: the index of acts of each text; `name` is its file's name. A text without acts has an index without rows."""
    escaped = F.replace(F.col("title"), F.lit("|"), F.lit("\\|"))
    body = numbered_list(outline, key, "position", F.concat(F.lit("| "), escaped, F.lit(" | "), "page", F.lit(" | "), "block", F.lit(" |")))
    head = F.concat(F.lit("# Indice atti sperimentale\n\n- Markdown sorgente: `"), name, F.lit("`\n- Uso: indice Markdown sperimentale e auditabile; non genera segnalibri PDF.\n- Pagina stimata: inizio del blocco Docling, non posizione intra-blocco dell'atto.\n\n| Titolo | Pagina stimata (inizio blocco) | Blocco |\n|---|---:|---:|"))
    return texts.select(key, head.alias("head")).join(body, key, "left").select(key, F.concat(F.concat_ws("\n", "head", "body"), F.lit("\n")).alias("markdown"))


def bookmark_index(texts: DataFrame, marks: DataFrame, key: str, name: Column) -> DataFrame:
    """key, markdown: the index of bookmarks of each text and the source they come from."""
    escaped = F.replace(F.col("title"), F.lit("|"), F.lit("\\|"))
    body = numbered_list(marks, key, "position", F.concat(F.lit("| "), escaped, F.lit(" | "), "page", F.lit(" |"))).join(marks.groupBy(key).agg(F.first("strategy").alias("strategy")), key)
    technical = F.when(F.col("strategy") == "page_chunks", "sì").otherwise("no")
    head = F.concat(F.lit("# Indice documentale\n\n- Markdown sorgente: `"), F.col("__name"), F.lit("`\n- Strategia segnalibri: `"), "strategy", F.lit("`\n- Fallback tecnico: "), technical, F.lit("\n- Le pagine derivate dal Markdown indicano l'inizio del blocco Docling.\n\n| Titolo | Pagina |\n|---|---:|\n"))
    return texts.select(key, name.alias("__name")).join(body, key).select(key, F.concat(head, "body", F.lit("\n")).alias("markdown"))


def top_metrics(docs: DataFrame) -> DataFrame:
    """Of each folder: the largest file, the commonest type of document and how many files have it, the share of PDF files."""
    kinds = docs.groupBy("casefile_id", F.coalesce("document_type", F.lit("sconosciuto")).alias("kind")).agg(F.count("*").alias("n"), F.max(F.struct(F.col("size_bytes"), (-F.col("case_doc_id")).alias("id"))).alias("top"), F.count_if(F.lower("extension") == ".pdf").alias("n_pdf"))
    out = kinds.groupBy("casefile_id").agg(F.max("top").alias("top"), F.max_by("kind", F.struct("n", F.col("kind"))).alias("commonest_type"), F.max("n").alias("n_commonest"), (F.sum("n_pdf") / F.sum("n")).alias("pdf_share"))
    return out.select("casefile_id", (-F.col("top.id")).alias("largest_doc"), F.col("top.size_bytes").alias("largest_size"), "commonest_type", "n_commonest", "pdf_share")
