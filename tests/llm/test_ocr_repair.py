import numpy as np

from spoglio.llm import ocr_repair as O
from spoglio.llm.boosting import Boosted


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = Boosted().fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_distance_prefers_confused_forms():
    assert O.distance("rnodello", "modello")[0] < O.distance("xodello", "modello")[0] < 2 and O.distance("a", "a") == (0.0, 0)


SENTENCES = [
    "Il giudice dispone la restituzione del registro presso il magazzino di Borgo entro trenta giorni.", "La perizia medico-legale descrive le lesioni riportate dalla persona offesa durante la notte.",
    "Il custode giudiziario ha consegnato il registro delle presenze alla cancelleria del tribunale.", "Gli operanti hanno rinvenuto il certificato di collaudo accanto al fabbricato numero sette.",
    "La difesa ha depositato il modulo di iscrizione come risulta dal verbale della sezione.", "Il consulente tecnico ha concluso la relazione con dieci pagine di allegati.",
]


def corpus(n=240):
    """(texts, truth) with known faults."""
    rng = np.random.default_rng(4)
    rows, truth = [], set()
    for job in range(1, n + 1):
        lines = ["Tribunale di Borgo", "", "Verbale", ""]
        for p in range(1, 5):
            words = " ".join(SENTENCES[i] for i in rng.permutation(6)[:4]).split(" ")
            now = ""
            for k, w in enumerate(words):
                at = len(lines) + 1
                clean = w.strip(".").lower()
                if len(now) > 55 and len(clean) > 7 and clean.isalpha() and rng.random() < 0.7:
                    lines.append(f"{now} {w[:4]}-".strip())
                    truth.add((job, at, "split", clean))
                    now = w[4:]
                    continue
                if len(now) + len(w) > 70:
                    lines.append(now.strip())
                    now = ""
                    at = len(lines) + 1
                if len(clean) > 7 and clean.isalpha() and rng.random() < 0.04:
                    truth.add((job, at, "misread", clean))
                    i = int(rng.integers(2, len(clean) - 2))
                    w = w[:i] + " " + w[i:] if rng.random() < 0.3 else w[:i] + "lc1f5nru0"[rng.integers(9)] + w[i + 1 :]
                now = f"{now} {w}"
            lines += [now.strip(), ""]
            truth.add((job, len(lines) + 1, "furniture", ""))
            lines.append(f"- {p} -")
            if p < 4:
                truth.add((job, len(lines) + 1, "furniture", ""))
                lines += [f"Fascicolo {job} - Borgo - pag. {p + 1}", ""]
        rows.append(("t", job, "\n".join(lines)))
    return rows, truth


def test_planted_faults(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows + [rows[0], ("t", 9001, None), ("t", 9002, ""), ("t", None, "x")], "table_name string, job_id long, markdown string").withColumn("word", df_lit("clash"))
    found = O.find_noise(df).collect()
    got = {(r.job_id, r.line_no, r.kind, r.word) for r in found}
    for kind, least in (("furniture", 0.97), ("split", 0.95), ("misread", 0.8)):
        g, t = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(g & t) >= least * len(t), (kind, len(g & t), len(t))
        assert len(g & t) >= least * len(g), (kind, list(g - t)[:5])


def df_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def test_repair_text():
    text = "Titolo\n\nIl giu-\n- 3 -\nFascicolo 2 - Borgo\n\ndice dispone la cons egna del R0TOLO.\nFine.\n\nAltro."
    cases = [(3, "split", "giudice", 3, 7), (4, "furniture", "", 0, 5), (5, "furniture", "", 0, 19), (7, "misread", "consegna", 16, 25), (7, "misread", "rotolo", 30, 36)]
    assert O.repair_text(text, cases) == "Titolo\n\nIl giudice dispone la consegna del ROTOLO. Fine.\n\nAltro."
    assert O.repair_text(None, []) is None and O.repair_text("", []) == ""


def test_empty(spark):
    empty = spark.createDataFrame([], "table_name string, job_id long, markdown string")
    assert O.find_noise(empty).count() == 0
    one = spark.createDataFrame([("t", 1, "solo"), ("t", 2, None)], "table_name string, job_id long, markdown string")
    assert [r.markdown for r in O.repair(one, O.find_noise(one)).collect()] == ["solo"]


def test_copies_dont_vouch_for_their_errors(spark):
    rows, _ = corpus(160)
    scan = "Tribunale di Borgo\n\nVerbale\n\nLa perizia descrive il magazz1no ed il reglstro del tribuna1e; il\ncustode ha conseqnato il magazzlno alla canceileria in data odierna."
    rows += [("t", 1000 + i, scan + f"\n\nAltro foglio numero {i} del fascicolo, senza allegati.") for i in range(60)]  # a quarter of all texts
    found = O.find_noise(spark.createDataFrame(rows, "table_name string, job_id long, markdown string")).where("job_id >= 1000 and kind = 'misread'").collect()
    for seen in ("reglstro", "conseqnato", "magazzlno"):
        assert sum(r.seen == seen for r in found) == 60, seen


def test_candidates_by_rarest_grams_lose_none():
    rng = np.random.default_rng(8)
    known = sorted({w.strip(".,").lower() for t in SENTENCES for w in t.split() if len(w) > 2})
    rank = {g: k for k, g in enumerate(sorted({g for w in known for g in O.grams(w)}))}
    index, posted = O.Index(known), [set(O.prefix(w, rank)) for w in known]
    for _ in range(400):
        w = O.misread(known[rng.integers(len(known))], rng)
        brute = [k for k in known if len(w) and abs(len(k) - len(w)) <= 2 and len(set(O.grams(k)) & set(O.grams(w))) >= max(1, O.least_common(max(len(k), len(w))))]
        own = set(O.prefix(w, rank))
        assert index.near(w) == brute
        assert set(brute) <= {k for k, p in zip(known, posted) if p & own}


def test_gaps_are_ranked(spark):
    rows, _ = corpus(200)
    text = "Tribunale di Borgo\n\nVerbale\n\nIl custode ha conse gnato il regi stro alla cancelleria del tribunale e la perizia de scrive il magazzino di Borgo."
    found = O.find_noise(spark.createDataFrame([*rows, ("t", 7000, text)], "table_name string, job_id long, markdown string")).where("job_id = 7000").collect()
    assert {("consegnato", "conse gnato"), ("registro", "regi stro"), ("descrive", "de scrive")} <= {(r.word, r.seen) for r in found if r.kind == "misread"}
