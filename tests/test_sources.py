import json
import os

import pytest

from spoglio.sources import indexes, plans, reports
from spoglio.sources.casedir import register
from spoglio.streaming import deliveries as D


@pytest.fixture()
def folder(tmp_path):
    case = tmp_path / "cases" / "one"
    (case / "999001").mkdir(parents=True)
    (case / ".hid").mkdir()
    (case / ".hid" / "x.pdf").write_bytes(b"x")
    (case / "999001" / "999001.pdf").write_bytes(b"%PDF-synthetic")
    (case / "999001" / "COMPLETE").write_bytes(b"")
    (case / "_kept.txt").write_text("Documento principale 001_sentenza.pdf\n\nab\n18/06/2026 - sentenza\n")
    (case / "999001" / "ListaAllegati.html").write_text("<html><title>Documento : 021 - SEGUITO D'INDAGINE</title><a href='atti/001.pdf'>Sentenza</a><ul><li><strong>FALDONE</strong> : FALDONE 2</li><li><strong>Data</strong> : 08/11/2024</li><li><strong>Tot. pagine</strong> : 7</li><li><strong>Nr. fascicolo</strong> : N 266/3-16/2024</li></ul>")
    (case / "elenco.csv").write_bytes("data;file;tipo\n18/06/2026;atti/001_sentenza.pdf;Sent\xe8nza\n".encode("latin-1"))
    (case / "indice.xml").write_text("<r><doc file='a.pdf'>uno</doc><doc file='a.pdf'/></r>")
    (case / "bomb.xml").write_text("<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>")
    os.symlink(case / "999001", case / "linked")
    return tmp_path / "cases"


def test_scan_and_indexes(spark, folder):
    register(spark)
    got = spark.read.format("casedir").option("content", "true").load(str(folder)).orderBy("scan_ord").collect()
    assert [r.relative_path for r in got] == ["999001/999001.pdf", "999001/COMPLETE", "999001/ListaAllegati.html", "_kept.txt", "bomb.xml", "elenco.csv", "indice.xml"]
    assert got[1].size_bytes == 0 and got[0].sha256 and {r.casefile_id for r in got} == {"one"}
    files = spark.read.format("casedir").option("content", "true").load(str(folder))
    found = {(r.index_path, r.row_number): r for r in indexes.parse_indexes(files).collect()}
    assert found["_kept.txt", 1].referenced_path == "001_sentenza.pdf" and found["_kept.txt", 2].document_date == "18/06/2026" and ("_kept.txt", 3) not in found
    assert found["elenco.csv", 1].referenced_path == "atti/001_sentenza.pdf" and ("elenco.csv", 2) not in found
    assert found["999001/ListaAllegati.html", 1].confidence == "high" and found["indice.xml", 1].referenced_path == "a.pdf" and ("indice.xml", 2) not in found
    assert found["bomb.xml", None].warning == "index_parse_error: ValueError"
    act = indexes.parse_acts(files).first()
    assert (act.act_number, act.act_title, act.faldone_number, act.total_pages, act.pg_progressive) == ("021", "SEGUITO D'INDAGINE", 2, 7, 16)


def test_missing_folder(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="(?s)FileNotFoundError|nowhere"):
        spark.read.format("casedir").load(str(tmp_path / "nowhere")).count()


def test_html_rows_unseen_by_links():
    got = [e for e in indexes.parse_html("<a href='x.pdf'>Uno due</a><table><tr><td>x.pdf</td></tr><tr><td>y.pdf</td></tr></table>") if e]
    assert [(e["referenced_path"], e["confidence"]) for e in got] == [("x.pdf", "high"), ("y.pdf", "low")]


def test_plans_and_manifests(spark, tmp_path):
    from spoglio.operators.jobs import verify_outputs

    (tmp_path / "c").mkdir()
    item = {"final_order": 1, "unit_id": "a", "source_pdf": "a.pdf", "include_in_merged_pdf": True, "warnings": [{"code": "w", "message": "m", "path": None}]}
    (tmp_path / "c" / "fascicolo_merge_plan.json").write_text(json.dumps({"items": [item]}))
    (tmp_path / "c" / "fascicolo_merge_plan_revised.json").write_text(json.dumps({"items": [item | {"final_order": 9}]}))
    items = plans.prefer_revised(plans.read_plans(spark, str(tmp_path / "c" / "fascicolo_merge_plan*.json")))
    assert [(r.casefile_id, r.final_order, r.warnings[0].code) for r in items.collect()] == [("c", 9, "w")]
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "job": {"status": "success"}, "processing": {"ocr_searchable_pdf_requested": True}, "outputs": {"markdown": "a.md", "searchable_pdf": "s.pdf", "manifest": "m.json"}}))
    listing = spark.createDataFrame([("a.md", 5)], "path string, size_bytes long")
    got = {r.output: (r.required, r.exists) for r in verify_outputs(plans.read_manifests(spark, str(tmp_path / "m.json")), listing).collect()}
    assert got["markdown"] == (True, True) and got["searchable_pdf"] == (False, False) and got["run_log"] == (True, False) and got["index_markdown"] == (False, False)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", True, 1), (None, False, None)], "t string, flag boolean, n int")
    assert "| a\\|b | True | 1 |" in reports.case_markdown("x", [("s", df), ("leer", df.limit(0))])
    reports.write_plan_csv(df, str(tmp_path / "p.csv"))
    assert (tmp_path / "p.csv").read_bytes().startswith(b"\xef\xbb\xbft;flag;n\r\na|b;s\xc3\xac;1")
    reports.write_plan_json(df, str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text())["items"][1]["t"] is None
    reports.write_csv(df, str(tmp_path / "d"))
    reports.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(IsADirectoryError):
        reports.write_plan_csv(df, str(tmp_path / "d"))
    with pytest.raises(ValueError):
        reports.case_markdown("x", [("s", df)], most=1)


def test_stream_counts_a_record_once(spark, tmp_path):
    rows = [(1, "c", "2024-01-01 00:00:00"), (1, "c", "2024-01-05 00:00:00"), (2, "c", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "job_id long, casefile_id string, t string").selectExpr("job_id", "casefile_id", "cast(t as timestamp) ingested_at")
    df.write.parquet(str(tmp_path / "in"))
    q = D.first_deliveries(D.deliveries(spark, str(tmp_path / "in"), df.schema), "job_id").writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.job_id for r in spark.table("once").collect()) == [1, 2]


def test_plan_reports(spark, tmp_path):
    from spoglio.operators import audit as A
    from spoglio.plans import fixtures

    items, docs = (df.where("casefile_id = 'a'") for df in fixtures._plan(spark))
    reports.write_validation(str(tmp_path), A.plan_rows(items, docs), A.validate_plan(items, docs), "piano.json")
    data, text = json.loads((tmp_path / "validation.json").read_text()), (tmp_path / "validation.md").read_text()
    assert not data["ok"] and data["total_items"] == 8 and len(data["errors"]) == 5 and len(data["warnings"]) == 9 and len(data["items"]) == 8
    assert "Esito: ERRORE" in text and "- Ordine duplicato tra item inclusi: 1." in text and "| 7 | no |  | 7 | 7/7.pdf | 0 | 1 |" in text
    e = A.estimate_items(items, docs)
    reports.write_estimate(str(tmp_path), e, A.estimate_totals(e), "piano.json")
    table = (tmp_path / "estimate.csv").read_bytes().decode("utf-8-sig").split("\r\n")
    assert table[0] == "order;included;title/bookmark;source_pdf;pages;size_bytes;warning;reason" and table[1].startswith("1;si;001 - Uno;1/1.pdf;3;2048;;") and table[-2].startswith(";no;;7/7.pdf;;;;doppione")
    assert "Atti esclusi: 1" in (tmp_path / "estimate.md").read_text() and "- solo_codice" in (tmp_path / "estimate.md").read_text()
    with pytest.raises(ValueError, match="over 3 rows"):
        reports.validation_report(A.plan_rows(items, docs), A.validate_plan(items, docs), "x", most=3)
