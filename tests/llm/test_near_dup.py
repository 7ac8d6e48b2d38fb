import random
import re
from itertools import combinations

import numpy as np

from spoglio.llm import near_dup as N


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = rng.choice(N.LEVELS[1:], 300)
    b = np.where(rng.random(300) < 0.4, rng.choice(N.LEVELS, 300), a)
    one = N.bag_min_hash(items, a, np.zeros(300, int), 1, 3000)
    two = N.bag_min_hash(items[b > 0], b[b > 0], np.zeros((b > 0).sum(), int), 1, 3000)
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert np.isfinite(one).all()


def collection(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 3)):
            t = list(base)
            for _ in range(rng.randrange(0, len(t) // 4)):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [rng.choice(words)], [t[i], rng.choice(words)]])
            out.append(", ".join(t).upper())
    return out


def brute(texts, k, threshold):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_against_all_pairs(spark):
    texts = dict(enumerate(collection(60), 1))
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    for how in ({"k": 3, "threshold": 0.5, "bands": 80, "rows": 2, "min_hits": 2, "counted": False}, {"counted": False}):
        links, members = N.near_duplicates(df, "id", "t", **how)
        got = {(r.id_a, r.id_b) for r in N.record_pairs(links, members).collect()}
        want = brute(texts, how.get("k", 5), how.get("threshold", 0.8))
        assert got <= want and len(got) >= 0.99 * len(want)


def test_copies_nulls_and_blocks(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, base, "x") for i in range(1, 41)] + [(100 + i, base + f" z{i} y{i}", "x") for i in range(30)] + [(500, None, "x"), (501, "", "x"), (502, "a b", "x"), (1, base, "x"), (None, base, "x")]
    df = spark.createDataFrame(rows, "id long, t string, class_id string")
    links, members = N.near_duplicates(df, "id", "t", bucket_block=4)
    assert members.count() == 70 and members.where("n_copies = 40").count() == 40
    want = brute({i: t for i, t, _ in rows if i and t and len(t) > 5}, 5, 0.8)
    pairs = lambda copies: {(r.id_a, r.id_b) for r in N.record_pairs(links, members, copies).collect()}
    assert pairs(64) == want
    few = pairs(10)
    assert few < want and {(1, i) for i in range(2, 41)} <= few and {(1, 100 + i) for i in range(30)} <= few
    groups = N.components(links, members).collect()
    assert {r.group_id for r in groups} == {1} and {r.n_links for r in groups if r.id == 1} == {30}
    links, members = N.near_duplicates(df.limit(0), "id", "t")
    assert links.count() == 0 and members.count() == 0 and N.components(links, members).count() == 0


def test_hot_group_with_long_insertions(spark):
    hot = [f"h{i}" for i in range(62)]
    texts = {i: " ".join(hot + [f"r{i}x{j}" for j in range(3)]) for i in range(1, 41)}  # fills more than one text of twenty
    texts |= {100 + i: " ".join(hot + [f"long{i}x{j}" for j in range(44 + i)]) for i in range(10)}  # most of each is rare
    texts |= {500 + i: " ".join(f"o{i}x{j}" for j in range(60)) for i in range(60)}
    links, members = N.near_duplicates(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t", k=3, threshold=0.5, bands=80, rows=2, min_hits=2, counted=False)
    got, want = {(r.id_a, r.id_b) for r in N.record_pairs(links, members).collect()}, brute(texts, 3, 0.5)
    assert sum(a < 100 <= b for a, b in want) > 300
    assert got <= want and len(got) >= 0.99 * len(want)


def test_every_copy_of_a_large_class_has_its_pairs(spark):
    base = " ".join(f"w{i}" for i in range(40))
    texts = {i: base for i in range(1, 71)} | {100 + i: base + f" z{i}" for i in range(3)}
    links, members = N.near_duplicates(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t")
    want = brute(texts, 5, 0.8)
    assert len(want) == 73 * 72 // 2
    for how in ({}, {"block": 8}):
        got = [(r.id_a, r.id_b) for r in N.record_pairs(links, members, **how).collect()]
        assert len(got) == len(want) and set(got) == want


def bags(text, k):
    w = re.findall(r"[^\W_]+", text.lower())
    out = {}
    for j in range(len(w) - k + 1):
        out[tuple(w[j : j + k])] = out.get(tuple(w[j : j + k]), 0) + 1
    return out


def overlap(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(x, 0), b.get(x, 0)) for x in keys) / max(1, sum(max(a.get(x, 0), b.get(x, 0)) for x in keys))


def test_bags_are_signed_and_verified_with_their_counts(spark):
    rng = random.Random(11)
    texts = {}
    for g in range(25):
        phrases = [" ".join(f"g{g}p{p}w{i}" for i in range(7)) for p in range(6)]
        base = [rng.choice(phrases) for _ in range(40)]
        for v in range(4):
            texts[10 * g + v + 1] = " ".join(base if not v else [rng.choice(phrases) if rng.random() < 0.04 * v else p for p in base])
    b = {i: bags(t, 5) for i, t in texts.items()}
    want = {(i, j) for i, j in combinations(sorted(b), 2) if overlap(b[i], b[j]) >= 0.8}
    sets = {(i, j) for i, j in combinations(sorted(b), 2) if len(b[i].keys() & b[j].keys()) >= 0.8 * len(b[i].keys() | b[j].keys())}
    links, members = N.near_duplicates(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t")
    got = {(r.id_a, r.id_b) for r in N.record_pairs(links, members).collect()}
    assert want < sets or want - sets  # the counts matter
    assert got <= want and len(got) >= 0.98 * len(want)
    some = links.first()
    assert abs(some.similarity - overlap(b[some.id_a], b[some.id_b])) < 1e-9


def test_recall_at_every_share_of_common_shingles(spark):
    rng, texts, i = random.Random(5), {}, 0
    hot = [f"h{j}" for j in range(202)]
    for share in [x / 10 for x in range(11)]:
        for _ in range(12):
            n = int(200 * share)
            own = [f"r{i}x{j}" for j in range(200 - n)]
            at = rng.randrange(1, 203 - n) if n else 0
            base = hot[at : at + n] + own
            more = [f"n{i}x{j}" for j in range(190)]  # just above one half
            texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(base + more)
            i += 1
    texts |= {10_000 + j: " ".join(hot) + f" z{j} y{j}" for j in range(60)}
    links, members = N.near_duplicates(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t", k=3, threshold=0.5, bands=80, rows=2, min_hits=2, counted=False)
    got = {(r.id_a, r.id_b) for r in N.record_pairs(links, members).collect()}
    want = {p for p in brute(texts, 3, 0.5) if p[1] < 10_000 and p[0] // 2 == p[1] // 2}
    assert len(want) > 120
    for tenth in range(11):
        own = {p for p in want if p[0] // 24 == tenth}
        assert len(own & got) >= 0.98 * len(own), tenth


def test_a_text_with_common_shingles_and_one_without(spark):
    hot = [f"h{j}" for j in range(80)]
    texts = {10_000 + j: " ".join(hot) + f" z{j} y{j}" for j in range(80)}  # makes the hot shingles common
    for i in range(120):
        own = [f"r{i}x{j}" for j in range(120)]
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(own + hot[:40])  # all that is shared is rare
    for counted in (False, True):
        links, members = N.near_duplicates(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t", k=3, threshold=0.5, bands=80, rows=2, min_hits=2, counted=counted)
        got = {(r.id_a, r.id_b) for r in N.record_pairs(links, members).collect()}
        assert {(2 * i, 2 * i + 1) for i in range(120)} <= got


def test_disk_stays_below_four_times_the_input(spark, tmp_path):
    import threading
    from pathlib import Path

    from spoglio.session import shared_dir

    rng = random.Random(3)
    stock = [" ".join(rng.choice("abcdefghilmnoprstuv") * 2 + str(rng.randrange(400)) for _ in range(12)) for _ in range(400)]
    texts = [" ".join(rng.choice(stock) if rng.random() < 0.7 else " ".join(f"x{rng.randrange(10**6)}" for _ in range(12)) for _ in range(36)) for _ in range(2500)]
    spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string").coalesce(4).write.parquet(str(tmp_path / "texts"))
    size = sum(p.stat().st_size for p in (tmp_path / "texts").rglob("*.parquet"))
    local = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    places = [Path(p) for p in [shared_dir(spark).removeprefix("file://"), *local]]

    def used():
        total = 0
        for p in (p for place in places for p in place.rglob("*")):
            try:
                total += p.stat().st_size if p.is_file() else 0
            except OSError:
                pass
        return total

    floor, most, done = used(), [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            most[0] = max(most[0], used() - floor)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        links, members = N.near_duplicates(spark.read.parquet(str(tmp_path / "texts")), "id", "t", k=3, threshold=0.5, bands=80, rows=2, min_hits=2, counted=False)
    finally:
        done.set()
        watcher.join()
    assert members.count() == 2500
    assert size > 2_000_000 and most[0] < 4 * size


def test_crowded_buckets_in_pieces(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(base + [f"z{i}", f"y{i}"]) for i in range(1, 91)} | {200 + i: " ".join(f"o{i}x{j}" for j in range(30)) for i in range(10)}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    want = brute(texts, 3, 0.5)
    for block in (1, 4, 256):
        links, members = N.near_duplicates(df, "id", "t", k=3, threshold=0.5, bands=80, rows=2, min_hits=2, counted=False, bucket_block=block)
        assert {(r.id_a, r.id_b) for r in links.collect()} == want and len(want) == 90 * 89 // 2


def test_words_are_runs_of_letters_and_digits():
    texts = ["", "Perché NON_è così; l'art.12-bis", "  İstanbul ǅ ½ ٣ x²\n\tß", "\U0001d400\U0001f600 a\ud800b", "一二 é"]
    for many in (texts, [t for t in texts for _ in range(3)]):
        hashes, at = N.words(many)
        flat = [w for t in many for w in re.findall(r"[^\W_]+", t.lower())]
        assert list(np.diff(at)) == [len(re.findall(r"[^\W_]+", t.lower())) for t in many]
        assert len({*zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))
    got = list(N.shingles(["a b c a b c a b", "a b", "", "b c a"], 3))
    assert [g[2] for g in got] == [8, 2, 0, 3] and sorted(got[0][1]) == [2, 2, 2] and not len(got[1][0]) and got[3][0][0] in got[0][0]
