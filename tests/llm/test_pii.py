import pytest

from spoglio.llm import pii

TEXT = """L'avv. ROSSI Maria del foro di Borgo ha indicato l'indirizzo m.rossi+atti @ studio.example e il numero (021) 5550611.
Il teste
[14]
Bianchi, in possesso della tessera RSS MRA 85T10 A562S, abita in Via del Tiglio, n. 130 int. 6, 23147 Borgo dal 1 maggio 2020.
Procedimento R.G. 8690/2022, prot. 6555-21/2023, numero 3829."""


def found(text, **how):
    return {(k, text[a:z]) for a, z, k in pii.find(text, **how)}


def test_finds_each_kind_to_its_boundary():
    assert found(TEXT) == {("name", "ROSSI Maria"), ("email", "m.rossi+atti @ studio.example"), ("phone", "(021) 5550611"), ("name", "Bianchi"), ("id_number", "RSS MRA 85T10 A562S"), ("address", "Via del Tiglio, n. 130 int. 6, 23147 Borgo")}


@pytest.mark.parametrize("text,kind,value", [
    ("a [at] b.example", "email", "a [at] b.example"), ("scrivere a x_y(at)pec.b-c.example.", "email", "x_y(at)pec.b-c.example"), ("tel. +39 338 5552578", "phone", "+39 338 5552578"), ("al 00393245555134;", "phone", "00393245555134"),
    ("numero 387/5558952", "phone", "387/5558952"), ("359 555 60 07", "phone", "359 555 60 07"), ("AS 9544441", "id_number", "AS 9544441"), ("U1A389138T,", "id_number", "U1A389138T"), ("tnczsn32l52b819o", "id_number", "tnczsn32l52b819o"),
    ("c/o Via XII Brigata 178/C", "address", "Via XII Brigata 178/C"), ("P.zza dei Carpini snc - 75251 Borgo.", "address", "P.zza dei Carpini snc - 75251 Borgo"),
])
def test_forms(text, kind, value):
    assert (kind, value) in found(text)


@pytest.mark.parametrize("text", ["il 13.09.2018 e il 26-02-2019", "prot. 6555-21/2023", "in via telematica 12", "davanti al giudice di Borgo", "", None, "@", "(at)", "Nel corso della perquisizione 5"])
def test_nothing_personal(text):
    assert pii.find(text) == []


def test_short_fields_and_lists():
    assert found("Collegio: ROSSI Maria - Bianchi Ugo - S. Verdi", loose_names=True) == {("name", "ROSSI Maria"), ("name", "Bianchi Ugo"), ("name", "S. Verdi")}
    assert found("GOT L. Verdi GFD PTN 03T41 F743E", loose_names=True) == {("name", "L. Verdi"), ("id_number", "GFD PTN 03T41 F743E")}
    assert found("non indicato", loose_names=True) == set()


def test_lexicon_without_cue():
    assert found("co-\nntattare Rossi Ugo al", lexicon=frozenset({"rossi", "ugo"})) == {("name", "Rossi Ugo")}


def test_redaction_changes_nothing_else():
    spans = pii.find(TEXT)
    out = pii.redact(TEXT)
    kept, at = [], 0
    for a, z, _ in spans:
        kept.append(TEXT[at:a])
        at = z
    kept.append(TEXT[at:])
    for piece in kept:
        assert piece in out
    assert out.count("[NAME]") == 2 and pii.redact(None) is None and pii.redact("") == ""


def test_frames(spark):
    df = spark.createDataFrame([(1, TEXT, "x"), (1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (None, TEXT, "x"), (4, "Il teste Rossi " + "parola " * 30_000, "x")], "id long, t string, kind string")
    got = pii.find_personal_information(df, "id", "t")
    assert got.columns == ["rec_id", "kind", "value"] and got.where("rec_id = 1").count() == 6 and got.count() == 7
    assert pii.find_personal_information(df.limit(0), "id", "t").count() == 0
    assert pii.redact_column(df, "t").columns == ["id", "t", "kind"]


def test_identity_numbers_from_their_joints_and_cues():
    for text, value in (("nata a Borgo, codice fiscale: RSSMRALRTMLALSMS x", None), ("C.F. rssmra85t10a562s;", "rssmra85t10a562s"), ("carta CA 12345 AB del", "CA 12345 AB"), ("RSS MRA 85T10 A562S, CA12345AB", "CA12345AB"), ("vedi mailto:a.b@c.example", None), ("del 130 e il 13", None)):
        got = {v for k, v in found(text) if k == "id_number"}
        assert (value in got) if value else not got - {"RSSMRALRTMLALSMS"}
    assert ("email", "a.b@c.example") in found("vedi mailto:a.b@c.example") and ("phone", "+393385552578") in found("tel:+393385552578")


def test_a_long_text_is_swept_once():
    import time

    text = " ".join(f"avv. Rossi Ugo, via del Tiglio, n. {i}, 23147 Borgo, x{i}@y.example, 021 555{i:04d}." for i in range(4000))
    began = time.time()
    spans = pii.find(text)
    assert time.time() - began < 8 and len(spans) == 4 * 4000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_a_long_list_of_names_gives_the_same(spark):
    rows = [(i, f"Il teste Rossi{c} Ugo ha detto. Il teste Rossi{c} Ugo tace. co-\nntattare Rossi{c} Ugo al", "x") for i, c in enumerate("abcabcabc" * 3)] + [(99, None, "x"), (100, "", "x"), (101, "niente", "x")]
    df = spark.createDataFrame(rows, "id long, t string, word string")
    few, many = (sorted(map(tuple, pii.find_personal_information(df, "id", "t", most=m).collect())) for m in (1000, 1))
    assert few == many and len(few) == 27
    one, two = (sorted(map(tuple, pii.redact_column(df, "t", words=pii.name_words(df, "t"), most=m).na.fill("-").collect())) for m in (1000, 1))
    assert one == two and len(one) == 30 and str(one).count("[NAME]") == 81
