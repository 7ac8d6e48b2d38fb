import pytest
from pyspark.sql import functions as F

from spoglio.functions import rules
from spoglio.functions import text as T


def values(spark, column, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} string")
    return [r.v for r in df.select("i", expr(F.col(column)).alias("v")).orderBy("i").collect()]


def test_fold_agrees_with_the_general_form(spark):
    rows = ["Memòria DIFENSÌVA", "Straße", "perché no", "plain", "", None]
    assert values(spark, "c", rows, T.fold) == ["memoria difensiva", "strasse", "perche no", "plain", "", None] == values(spark, "c", rows, T.fold_any)


def test_paths(spark):
    rows = ["a/b.PDF", ".pdf", "x/.hidden", "a\\c.tar.gz", "COMPLETE", None]
    assert values(spark, "c", rows, lambda c: T.suffix(T.basename(c))) == [".pdf", "", "", ".gz", "", None]
    assert values(spark, "c", ["001_x.pdf", "1234567.pdf", "12", "a1", None], T.leading_number) == [1, None, 12, None, None]
    assert values(spark, "c", ["../foo/bar.pdf", "./a.pdf", "C:\\x\\y.pdf", "https://h.example/p/q.pdf?x=1", "a%20b+c.pdf", "100%.pdf", "", None], T.safe_reference) == ["bar.pdf", "a.pdf", "y.pdf", "q.pdf", "a b+c.pdf", "100%.pdf", None, None]


def test_small_text_functions(spark):
    assert values(spark, "c", ["18/06/2026 - x", "2024-01-02", "no", None], T.first_date) == ["18/06/2026", "2024-01-02", None, None]
    assert values(spark, "c", ["vedi (001 a.pdf).", "x", None], T.first_pdf) == ["a.pdf", None, None]
    assert values(spark, "c", ["a\u00a0 b\n c ", None], T.squeeze) == ["a b c", None]
    assert values(spark, "c", ["abcdefgh", "abc", None], lambda c: T.shorten(c, 6)) == ["abc...", "abc", None]
    got = values(spark, "c", ["08/11/5202", "31/02/2024", "2024-05-06", "x", None], T.day_key)
    assert [(g.y, g.m, g.d, g.odd) for g in got] == [(5202, 11, 8, True), (2024, 2, 31, False), (2024, 5, 6, False), (9999, 99, 99, False), (9999, 99, 99, False)]


@pytest.mark.parametrize("path,kind,confidence", [
    ("001_sentenza.pdf", "sentenza", "high"), ("SENTENZA.PDF", "sentenza", "high"), ("ord_2026.pdf", "ordinanza", "high"), ("decr. fissazione.pdf", "decreto", "high"), ("verbale_udienza_12-5-2026.pdf", "verbale_udienza", "high"),
    ("rinvio udienza.pdf", "verbale_udienza", "medium"), ("cartella/memòria difensìva.pdf", "memoria", "medium"), ("richiesta copie.pdf", "istanza", "medium"), ("all. 1.pdf", "allegato", "low"), ("x/COMPLETE", "marker_tecnico", "high"), ("", "sconosciuto", "low"),
])
def test_file_rules(spark, path, kind, confidence):
    got = values(spark, "c", [path], rules.file_type)[0]
    assert (got.kind, got.confidence) == (kind, confidence)


def test_act_rules_and_their_order(spark):
    cases = {
        "CERTIFICATO MEDICO": "certificato", "Comunicazione notizia di reato": "informativa", "Avviso di conclusione": "comunicazione", "S.I.T.": "sit_sommarie_informazioni", "Decreto del GIP": "provvedimento_gip_gup", "Ordine del pubblico ministero": "provvedimento_pm",
        "Seguito d'indagine": "informativa", "Referto": "documentazione_sanitaria", "boh": "altro", "": "altro", None: "altro",
    }
    got = values(spark, "c", list(cases), lambda c: rules.act_category(c, F.lit(None).cast("string")))
    assert [g.kind for g in got] == list(cases.values())
    assert values(spark, "c", ["verbale", None, "zzz"], lambda c: rules.sort_group(c)["sort_priority"]) == [40, 90, 90]
