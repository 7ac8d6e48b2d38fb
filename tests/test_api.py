from spoglio.api import analyze
from spoglio.operators import audit as A


def test_end_to_end(spark, tmp_path):
    for unit, title, day in (("100", "CERTIFICATO PENALE", "08/11/5202"), ("200", "VERBALE DI ARRESTO", "01/02/2024")):
        d = tmp_path / "caso" / unit
        d.mkdir(parents=True)
        (d / f"{unit}.pdf").write_bytes(unit.encode())
        (d / "COMPLETE").write_bytes(b"")
        (d / "allegato uno.pdf").write_bytes(b"same")
        (d / "ListaAllegati.html").write_text(f"<title>Documento : 0{unit} - {title}</title><li><strong>Data</strong> : {day}</li><a href='allegato%20uno.pdf'>Allegato</a><a href='{unit}.pdf'>Atto</a>")
    (tmp_path / "caso" / "indice.xml").write_text("<broken")
    a = analyze(spark, str(tmp_path))
    assert a.documents.count() == 9
    assert {(r.unit_id, r.act_category, r.suggested_order, r.anomalous_date) for r in a.units.collect()} == {("100", "certificato", 2, True), ("200", "verbale", 1, False)}
    assert [(r.unit_id, r.final_order, r.bookmark_title) for r in a.plan.orderBy("final_order").collect()] == [("200", 1, "VERBALE DI ARRESTO"), ("100", 2, "CERTIFICATO PENALE")]
    assert sorted(r.strategy for r in a.matches.collect()) == ["ambiguous", "ambiguous", "basename_exact", "basename_exact"]
    assert [r.warning for r in a.entries.where("warning is not null").collect()] == ["index_parse_error: ParseError"]
    assert [r.relative_path for r in a.duplicates.collect()] == ["200/allegato uno.pdf"]
    assert a.profiles.first().profile == "ministeriale_tiap"
    found = A.validate_plan(a.plan, a.documents).collect()
    assert {r.severity for r in found} == {"warning"} and sorted(r.message.split(": ", 1)[1] for r in found) == ["numero pagine mancante o zero.", "numero pagine mancante o zero.", "warning già presente nel piano: Data atto anomala: 08/11/5202"]
    assert [r.bookmark_label for r in a.plan.orderBy("final_order").collect()] == ["001 - VERBALE DI ARRESTO", "002 - CERTIFICATO PENALE"]
    # every entry has exactly one outcome, orders are a permutation, no result holds the root
    assert a.matches.count() == a.entries.where("warning is null").count()
    assert not [r for r in a.documents.collect() if str(tmp_path) in str(r)]
