import random

from spoglio.llm import lang_id as G

S = {
    "it": ["Il giudice ha disposto la restituzione della copia", "La difesa ha depositato il verbale presso la cancelleria", "Gli operanti hanno trovato una borsa nella stanza"],
    "en": ["The judge ordered the release of the copy", "The defence filed the record with the registry", "The officers found a bag in the room"],
    "fr": ["Le juge a ordonné la restitution de la copie", "La défense a déposé le procès-verbal au greffe", "Les agents ont trouvé un sac dans la pièce"],
    "de": ["Der Richter hat die Rückgabe der Kopie angeordnet", "Die Verteidigung hat das Protokoll eingereicht", "Die Beamten haben eine Tasche in dem Zimmer gefunden"],
    "es": ["El juez ordenó la devolución de la copia", "La defensa presentó el acta en la secretaría", "Los agentes encontraron una bolsa en la habitación"],
}


def par(rng, l):
    return ". ".join(rng.sample(S[l], 2)) + f" {rng.randrange(999)}."


def test_stretches_of_planted_texts(spark):
    rng, rows, truth = random.Random(5), [], {}
    for i in range(300):
        langs = [rng.choice(list(S))]
        langs = langs * rng.randrange(1, 4) + ([rng.choice(list(S))] if rng.random() < 0.3 else [])
        text = "\n\n".join(par(rng, l) for l in langs)
        text = text.upper() if rng.random() < 0.1 else text
        label = rng.choice([langs[0], langs[0], langs[0].upper() + "-x", None, "it"])
        rows.append((i, text, label, "clash"))
        runs = []
        for k, l in enumerate(langs, 1):
            if runs and runs[-1][2] == l:
                runs[-1][1] = k
            else:
                runs.append([k, k, l])
        truth[i] = [tuple(r) for r in runs]
    rows += [(900, None, None, "x"), (901, "", "it", "x"), (902, "prot. 6105-49/2014 - 771/78", None, "x"), (903, par(rng, "en") + "\n\n12/5\n\n" + par(rng, "en"), None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, doc_lang string")
    found = G.identify_languages(df).collect()
    got = {}
    for r in found:
        if r.lang:
            got.setdefault(r.doc_id, []).append((r.para_from, r.para_to, r.lang))
    right = sum(sorted(got.get(i, [])) == t for i, t in truth.items())
    assert right >= 0.97 * len(truth)
    assert got[903] == [(1, 3, "en")] and not {900, 901, 902} & set(got)
    cases = {r.doc_id for r in G.mislabelled(G.identify_languages(df)).collect()}
    for i, t, l, _ in rows[:300]:
        main = max(truth[i], key=lambda r: r[1] - r[0])[2]
        if len(truth[i]) == 1 and got.get(i) == truth[i]:
            assert (i in cases) == (l is None or l[:2].lower() != main)
    assert all(0 <= r.confidence <= 1 for r in found)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert G.identify_languages(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "Il giudice ha disposto la restituzione", None)], "doc_id long, text string, lang string")
    assert G.identify_languages(unlabelled).first().lang is None


def test_long_text_is_read_whole():
    rng = random.Random(1)
    text = "\n\n".join(par(rng, "it") for _ in range(3000))
    assert len(G.paragraphs(text)) == 3000
    x, words = G.counts([text])
    assert words[0] > 30_000
