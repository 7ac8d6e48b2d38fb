"""Sinks: distributed JSON and CSV, and small reports of one case folder written by the driver."""

from __future__ import annotations

import csv
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    flat = [F.when(F.col(f.name), "sì").otherwise("").alias(f.name) if f.dataType.simpleString() == "boolean" else F.col(f.name) for f in df.schema.fields]
    df.select(flat).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def _publish(path: str, text: str, encoding: str = "utf-8") -> None:
    """Whole or not at all: written beside and then renamed."""
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding=encoding, newline="") as f:
        f.write(text)
    os.replace(f.name, path)


def escape(value) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def case_markdown(title: str, sections: list[tuple[str, DataFrame]], most: int = 10_000) -> str:
    """A table for each section. For one folder's roll-ups: more than `most` rows are refused, not cut."""
    out = [f"# {title}", ""]
    for name, df in sections:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"section {name} has over {most} rows; write it with write_csv")
        out += [f"## {name}", ""]
        if rows:
            out += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
            out += ["| " + " | ".join(escape(v) for v in r) + " |" for r in rows]
        else:
            out.append("Nessuna voce.")
        out.append("")
    return "\n".join(out)


def write_case_report(path: str, title: str, sections: list[tuple[str, DataFrame]]) -> None:
    _publish(path, case_markdown(title, sections))


def write_plan_csv(items: DataFrame, path: str, most: int = 100_000) -> None:
    """One folder's plan for a spreadsheet: semicolons and a byte-order mark."""
    import io

    rows = items.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    buffer = io.StringIO()
    w = csv.writer(buffer, delimiter=";")
    w.writerow(items.columns)
    w.writerows([["" if v is None else "sì" if v is True else "" if v is False else v for v in r] for r in rows])
    _publish(path, buffer.getvalue(), "utf-8-sig")


def write_plan_json(items: DataFrame, path: str, most: int = 100_000) -> None:
    rows = items.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    _publish(path, json.dumps({"items": [r.asDict(recursive=True) for r in rows]}, ensure_ascii=False, indent=2, default=str) + "\n")


def _bounded(df: DataFrame, most: int) -> list:
    """The rows of one folder's report; more than `most` are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write them with write_csv or write_json")
    return rows


def _bullets(lines: list[str], none: str) -> list[str]:
    return [f"- {escape(x)}" for x in lines] or [none]


def validation_report(rows: DataFrame, findings: DataFrame, plan_name: str, most: int = 100_000) -> tuple[dict, str]:
    """(the validation of one folder's plan as a mapping, the same in Markdown). rows: audit.plan_rows, findings: audit.validate_plan, both of that folder."""
    items = sorted(_bounded(rows.select("index", "unit_id", "source_pdf", "included", "final_order", "errors", "warnings"), most), key=lambda r: r["index"])
    found = sorted(_bounded(findings, most), key=lambda r: (r["item"] is None, r["item"] or 0, r["severity"], r["message"]))
    errors, warnings = ([r["message"] for r in found if r["severity"] == s] for s in ("error", "warning"))
    included = sum(r["included"] for r in items)
    out = {"ok": not errors, "source_plan": plan_name, "total_items": len(items), "included_items": included, "excluded_items": len(items) - included, "errors": errors, "warnings": warnings, "items": [r.asDict() for r in items]}
    lines = ["# Validazione piano PDF fascicolo", "", f"Piano usato: {plan_name}", f"Item totali: {len(items)}", f"Inclusi: {included}", f"Esclusi: {len(items) - included}", f"Errori: {len(errors)}", f"Warning: {len(warnings)}", f"Esito: {'ERRORE' if errors else 'OK'}", ""]
    lines += ["## Errori", "", *_bullets(errors, "Nessun errore."), "", "## Warning", "", *_bullets(warnings, "Nessun warning."), "", "## Item", "", "| # | Incluso | Ordine | Atto | PDF sorgente | Errori | Warning |", "|---:|---|---:|---|---|---:|---:|"]
    for r in items:
        cells = [r["index"], "sì" if r["included"] else "no", r["final_order"] or "", r["unit_id"], r["source_pdf"], len(r["errors"]), len(r["warnings"])]
        lines.append("| " + " | ".join(escape(c) for c in cells) + " |")
    return out, "\n".join(lines) + "\n"


ESTIMATE_COLUMNS = ("order", "included", "title/bookmark", "source_pdf", "pages", "size_bytes", "warning", "reason")


def estimate_report(estimated: DataFrame, totals: DataFrame, plan_name: str, most: int = 100_000) -> tuple[str, str]:
    """(Markdown, CSV with semicolons) of one folder's estimate: included items by order, then the excluded ones. estimated: audit.estimate_items, totals: audit.estimate_totals."""
    rows = sorted(_bounded(estimated, most), key=lambda r: (not r["included"], r["order"] is None, r["order"] or 0, r["item_id"]))
    t, (inc, exc) = totals.first(), ([r for r in rows if r["included"] is want] for want in (True, False))
    row = lambda *cells: "| " + " | ".join(escape(c or "") for c in cells) + " |"
    lines = ["# Stima PDF unico fascicolo", "", f"Piano usato: {plan_name}", f"Atti inclusi: {len(inc)}", f"Atti esclusi: {len(exc)}", f"Pagine stimate: {t['estimated_pages'] if t else 0}", f"Dimensione stimata: {t['source_size'] if t else '0 B'}", f"Warning: {t['n_warnings'] if t else 0}", ""]
    lines += ["## Atti inclusi", "", "| Ordine | Titolo/segnalibro | PDF sorgente | Pagine | Dimensione | Warning |", "|---:|---|---|---:|---:|---|", *[row(r["order"], r["title"], r["source"], r["pages"], r["size"], r["warning"]) for r in inc], ""]
    lines += ["## Atti esclusi", "", "| Motivo | Titolo/segnalibro | PDF sorgente | Warning |", "|---|---|---|---|", *[row(r["reason"], r["title"], r["source"], r["warning"]) for r in exc], ""]
    lines += ["## Warning", "", *_bullets([w for r in rows if r["warning"] for w in r["warning"].split(" | ")], "Nessun warning.")]
    import io

    buffer = io.StringIO(newline="")
    w = csv.writer(buffer, delimiter=";")
    w.writerow(ESTIMATE_COLUMNS)
    w.writerows([[r["order"] or "", "si" if r["included"] else "no", r["title"] or "", r["source"] or "", r["pages"] or "", r["size_bytes"] or "", r["warning"], r["reason"] or ""] for r in rows])
    return "\n".join(lines) + "\n", buffer.getvalue()


def write_validation(folder: str, rows: DataFrame, findings: DataFrame, plan_name: str) -> None:
    data, text = validation_report(rows, findings, plan_name)
    _publish(os.path.join(folder, "validation.json"), json.dumps(data, ensure_ascii=False, indent=2, default=str) + "\n")
    _publish(os.path.join(folder, "validation.md"), text)


def write_estimate(folder: str, estimated: DataFrame, totals: DataFrame, plan_name: str) -> None:
    text, table = estimate_report(estimated, totals, plan_name)
    _publish(os.path.join(folder, "estimate.md"), text)
    _publish(os.path.join(folder, "estimate.csv"), table, "utf-8-sig")
