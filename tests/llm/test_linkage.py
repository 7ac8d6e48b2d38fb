import numpy as np
import pandas as pd

from spoglio.llm import linkage as L

ACTS = [(501, "Verbale di sommarie informazioni"), (502, "Verbale di arresto in flagranza"), (519, "Certificato medico"), (526, "Decreto di intercettazione")]


def test_attributes():
    read = L.Acts(ACTS).attributes
    assert read("Verb. arr. flag. n. prot. 35116 c/ Rossi del 3 aprile 2023") == (502, 20230403, 35116, "rossi")
    assert read("CertificatoMedico-verdone-20-01-2020") == (519, 20200120, None, "verdone")
    assert read("prot82713_verba_arres_flagr_Verdone") == (502, None, 82713, "verdone")
    assert read("scan 22.09.2015 38119") == (0, 20150922, 38119, None)
    assert read("A carico di Verdone - DECRETO DI INTERCETTAZIONE 5/5/17") == (526, 20170505, None, "verdone")
    assert L.Acts([(532, "Nomina del difensore"), (518, "Certificato del casellario"), (519, "Certificato medico")]).attributes("Certificato - Malvonazzo") == (0, None, None, "malvonazzo")
    assert read("") == read(None) == (0, None, None, None)
    assert L.squash("./Atti%20X/001_a.PDF") == "attix001apdf" and L.squash("--") is None


def test_em_recovers_shares():
    rng = np.random.default_rng(1)
    match = rng.random(20_000) < 0.3
    rows = {a: np.where(match, np.where(rng.random(20_000) < 0.9, k - 1, 0), np.where(rng.random(20_000) < 0.05, k - 1, 0)) for a, k in L.LEVELS.items()}
    df = pd.DataFrame(rows)
    patterns = df.groupby(list(L.LEVELS)).size().reset_index(name="n")
    chance = df[~match].groupby(list(L.LEVELS)).size().reset_index(name="n")
    g, model = L.fit(patterns, chance)
    assert abs(model["p"] - 0.3) < 0.02
    top = patterns[[*L.LEVELS]].to_numpy()
    assert g[(top == [k - 1 for k in L.LEVELS.values()]).all(1)][0] > 0.99 and g[(top == 0).all(1)][0] < 0.01


def test_links(spark):
    acts = spark.createDataFrame(ACTS, "canon_id int, canonical string")
    files = spark.createDataFrame(
        [(1, "c", "7/7.pdf"), (2, "c", "7/001_verbale_arresto_flagranza_20200102.pdf"), (3, "c", "7/Copia_001_verbale_arresto_flagranza_20200102.pdf"), (4, "c", "7/scan 03.04.2021 17093.pdf"), (5, "c", "8/CertificatoMedico verdone 05-05-2019.pdf"), (6, "c", "7/COMPLETE"), (7, "c", None), (8, None, "x.pdf"), (2, "c", "7/001_verbale_arresto_flagranza_20200102.pdf")],
        "case_doc_id long, casefile_id string, relative_path string",
    )
    e = [(1, "7/L.html", "Unità 7", None, None), (2, "7/L.html", "V.le arresto flagr.", None, "2/1/2020"), (3, "7/L.html", "x", "Copia%20001-VERBALE arresto flagranza 20200102.PDF", None), (4, "7/L.html", "Decreto intercettazione prot. 17093", None, None), (5, "7/L.html", "Certificato medico c/ Verdone", None, None),
         (6, "indice.xml", "Certificato medico c/ Verdnoe", None, None), (7, "7/L.html", "Certificato medico", None, None), (8, None, None, None, None), (2, "7/L.html", "V.le arresto flagr.", None, "2/1/2020")]
    entries = spark.createDataFrame([(i, "c", *r) for i, *r in e], "entry_id long, casefile_id string, index_path string, label string, referenced_path string, document_date string")
    got = {r.entry_id: r.case_doc_id for r in L.link_entries(entries, files, acts).collect()}
    # a certificate is in another unit than entry 5's index, and nothing but the act agrees with entry 7
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 6: 5}
    assert L.link_entries(entries.limit(0), files, acts).count() == 0
    assert L.link_entries(entries, files.limit(0), acts).count() == 0


def planted(n=300, hot=False):
    """Files, entries and the file each entry describes; with `hot` all in one folder, under one index at its root."""
    rng = np.random.default_rng(6)
    surnames = ["".join(rng.choice(list("bcdfglmnprstv"))+rng.choice(list("aeiou")) for _ in range(4)) + "xyzkw"[rng.integers(5)] for _ in range(200)]
    files, entries, truth, seen = [], [], {}, set()
    while len(files) < n:
        i, act, day, number, who = len(files) + 1, int(rng.integers(4)), f"{rng.integers(1, 29):02d}-{rng.integers(1, 13):02d}-20{rng.integers(10, 24)}", int(rng.integers(10_000, 99_999)), surnames[rng.integers(200)]
        if (act, day) in seen or (act, who) in seen:
            continue
        seen |= {(act, day), (act, who)}
        case, unit = ("c", "1") if hot else (f"c{i % 5}", str(i % 20))
        files.append((i, case, f"{unit}/{ACTS[act][1].replace(' ', '_')}_{who}_{day}_{number}.pdf"))
        spelt, at = list(who), int(rng.integers(len(who)))
        spelt[at] = "x"
        label = f"{ACTS[act][1]}" + [f" c/ {''.join(spelt)} del {day.replace('-', '/')}", f" del {day.replace('-', '/')} prot. {number}", f" prot. {number}", f" c/ {who} prot. {number}"][i % 4]
        entries.append((i, case, "indice.csv" if hot else f"{unit}/ListaAllegati.html", label, None, None))
        truth[i] = i
    return files, entries, truth


def frames(spark, files, entries):
    return spark.createDataFrame(entries, "entry_id long, casefile_id string, index_path string, label string, referenced_path string, document_date string"), spark.createDataFrame(files, "case_doc_id long, casefile_id string, relative_path string"), spark.createDataFrame(ACTS, "canon_id int, canonical string")


def test_planted_links_and_blocking_recall(spark):
    for hot in (False, True):
        files, entries, truth = planted(hot=hot)
        got = {r.entry_id: r.case_doc_id for r in L.link_entries(*frames(spark, files, entries)).collect()}
        right = sum(truth[e] == d for e, d in got.items())
        assert right >= 0.97 * len(truth) and right >= 0.98 * len(got), (hot, right, len(got))


def test_the_posterior_rejects_what_the_rule_alone_would_accept():
    # title, day, number, person, path, main: as often as in a collection of case folders
    rows = [((2, 2, 1, 1, 1, 1), 1640), ((2, 0, 1, 1, 0, 1), 1464), ((1, 1, 1, 1, 3, 2), 1354), ((2, 0, 1, 1, 1, 1), 1096), ((2, 1, 2, 1, 1, 1), 1008), ((2, 2, 1, 3, 3, 1), 949), ((2, 1, 1, 1, 1, 1), 784), ((2, 2, 2, 1, 3, 1), 779), ((2, 1, 0, 1, 0, 1), 671),
            ((2, 1, 0, 1, 1, 1), 588), ((2, 2, 1, 3, 1, 1), 534), ((2, 1, 1, 3, 1, 1), 528), ((2, 0, 1, 0, 0, 1), 467), ((2, 1, 1, 0, 0, 1), 370), ((0, 1, 1, 0, 1, 1), 235), ((2, 0, 0, 3, 1, 1), 4), ((1, 2, 2, 1, 1, 1), 21)]
    frame = lambda rs: pd.DataFrame([(*levels, n) for levels, n in rs], columns=[*L.LEVELS, "n"])
    chance = frame([((0, 0, 0, 0, 0, 1), 9000), ((0, 1, 1, 0, 1, 1), 5000), ((2, 0, 0, 0, 0, 1), 200), ((0, 0, 1, 3, 0, 1), 40), ((0, 2, 1, 0, 0, 1), 3)])
    odds, _ = L.fit(frame(rows), chance)
    least = L.threshold(odds, np.array([n for _, n in rows], dtype=float))
    accepted = {levels for (levels, _), o in zip(rows, odds) if 1 / (1 + np.exp(-o)) >= least}
    assert (2, 0, 0, 3, 1, 1) not in accepted and (2, 0, 1, 1, 0, 1) not in accepted and (0, 1, 1, 0, 1, 1) not in accepted
    assert {(2, 2, 1, 1, 1, 1), (2, 1, 2, 1, 1, 1), (1, 1, 1, 1, 3, 2), (2, 1, 1, 3, 1, 1), (1, 2, 2, 1, 1, 1)} <= accepted


def test_crowded_keys_meet_in_squares(spark):
    files, entries, _ = planted(60, hot=True)
    e = spark.createDataFrame([(i, "c", "", [501], [20200101 + i % 2], [], ["rossi"], None, None, None) for i in range(40)], "entry_id long, casefile_id string, unit string, titles array<int>, days array<long>, numbers array<long>, persons array<string>, ref_path string, ref_name string, main_of string")
    d = spark.createDataFrame([(i, "c", "1", 501, 20200101 + i % 2, None, "rossi", "p", "p", f"n{i}", False, False) for i in range(50)], "case_doc_id long, casefile_id string, file_unit string, title int, day long, number long, person string, path string, inner string, name string, is_main boolean, is_copy boolean")
    want = {(a, b) for a in range(40) for b in range(50)}
    for block in (4, 7, 256):
        rows = L._candidates(e, d, block).collect()
        assert len(rows) == len(want) and {(r.entry_id, r.case_doc_id) for r in rows} == want
