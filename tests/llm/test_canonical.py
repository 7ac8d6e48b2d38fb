import random

import pytest

from spoglio.llm.canonical import Trie, canonicalize, edits, fold

LIST = [(1, "Tribunale di Valdoria"), (2, "Corte d'Appello di Valdoria"), (3, "Corte d'Assise d'Appello di Valdoria"), (4, "Giudice di Pace di Valdoria"), (5, "Verbale di perquisizione locale"), (6, "Verbale di perquisizione personale"), (7, "Tribunale di Sorveglianza di Valdoria")]


@pytest.mark.parametrize("value,want", [
    ("Tribunale di Valdoria", 1), ("  TRIBUNALE  ORDINARIO DI VALDORIA - sez. II", 1), ("Trib.le Valdorria", 1), ("Valdoria - Corte d'Appello", 2), ("App. di Valdoria (corte)", 2), ("C. Ass. App. di Valdoria", 3), ("GdP Valdoria", 4), ("G.d.P. di Valdoria", 4),
    ("V.le perq. loc.", 5), ("023 - VERB DI PERQUIS. PERSONALE e allegati", 6), ("perquisizione locale (verbale)", 5), ("T.d.S. Valdoria", 7), ("Tribunale di Fontanera", 0), ("Prefettura di Valdoria", 0), ("Verbale di perquisizione", 0), ("", 0), ("()", 0), ("...", 0),
])
def test_values(value, want):
    assert Trie(LIST).find(value)[0] == want


def test_all_small_edits_are_found_as_by_brute_force():
    rng, trie = random.Random(3), Trie(LIST)
    for _ in range(300):
        n, text = rng.choice(LIST)
        word = list(fold(text))
        i = rng.choice([k for k in range(1, len(word) - 1) if "".join(word[k - 1 : k + 2]).isalpha()])
        kind = rng.randrange(3)
        if kind == 0:
            word[i] = rng.choice("aeiolrst")
        elif kind == 1:
            del word[i]
        else:
            word.insert(i, rng.choice("aeiolrst"))
        typed = "".join(word)
        near = sorted((edits(typed, fold(t)), m) for m, t in LIST)
        if near[0][0] <= 1 and near[1][0] > 3:
            assert trie.find(typed)[0] == near[0][1], typed


def test_frames(spark):
    entries = spark.createDataFrame([*LIST, (None, "x"), (9, None)], "canon_id int, canonical string")
    df = spark.createDataFrame([(1, "Trib. Valdoria", 9), (1, "Trib. Valdoria", 9), (2, None, 9), (3, "", 9), (4, "x" * 60_000, 9), (None, "Trib. Valdoria", 9)], "id long, v string, canon_id int")
    got = {r.rec_id: r.canon_id for r in canonicalize(df, "id", "v", entries).collect()}
    assert got == {1: 1, 3: 0, 4: 0}
    assert {r.canon_id for r in canonicalize(df, "id", "v", entries.limit(0)).collect()} == {0}
    assert canonicalize(df.limit(0), "id", "v", entries).count() == 0


def test_ties_answer_none():
    assert Trie([(1, "Alfa gamma"), (2, "Alfa gemma")]).find("Alfa gomma") == (0, None, 2)
