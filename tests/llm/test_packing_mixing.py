import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoglio.llm import mixing, packing
from spoglio.llm.tokens import count_tokens, tokenizer

WORDS = "giudice perizia verbale registro custode relazione sezione tribunale notte magazzino".split()


def docs(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(int(rng.expovariate(1 / 60)) + 1)), rng.choice(["a", "a", "a", "b", "c"])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "a"), (n + 2, "parola " * 9000, "b"), (n + 3, "sola", None), (0, rows[0][1], rows[0][2])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))


def test_token_counts(spark):
    rows, df = docs(spark, 50)
    got = {(r.doc_id, r.n_tokens) for r in count_tokens(df.drop("n_tokens"), ["doc_id"]).collect()}
    assert got == {(i, len(tokenizer().encode_ordinary(t)) if t else 0) for i, t, _ in rows}
    for t in (rows[0][1], "È l'atto n. 5/2020…  \n\n x's", "\t \n", "日本語 text ñ"):
        assert packing.measure(t)[0] == len(tokenizer().encode_ordinary(t))


def test_packing_keeps_everything(spark):
    rows, df = docs(spark)
    kinds = spark.createDataFrame([("s", 64), ("m", 512), (None, 5), ("zero", 0)], "container string, capacity_tokens int")
    size = {i: len(tokenizer().encode_ordinary(t)) for i, t, _ in rows if t}
    out = packing.pack_documents(df, kinds, shard_docs=150).collect()
    for name, cap in (("s", 64), ("m", 512)):
        own = [r for r in out if r.container == name]
        parts, bins = {}, {}
        for r in own:
            parts.setdefault(r.doc_id, []).append((r.part, r.from_token, r.n_tokens))
            bins[r.shard, r.bin] = bins.get((r.shard, r.bin), 0) + r.n_tokens
        assert set(parts) == set(size) and max(bins.values()) <= cap
        for i, ps in parts.items():
            ps.sort()
            assert sum(p[2] for p in ps) == size[i] and [p[1] for p in ps] == [cap * k for k in range(len(ps))]
            assert len(ps) == -(-size[i] // cap)
        assert sum(bins.values()) / (len(bins) * cap) > 0.95
    assert {r.container for r in out} == {"s", "m"}
    report = {r.container: r for r in packing.fill_report(packing.pack_documents(df, kinds)).collect()}
    assert report["m"].n_tokens == sum(size.values())
    assert packing.pack_documents(df.limit(0), kinds).count() == 0 and packing.pack_documents(df, kinds.limit(0)).count() == 0


def test_bm25_prefers_common_rare_terms():
    idf = np.ones(packing.TERMS, dtype=np.float32)
    idf[7] = 5
    t = [np.array([1, 7]), np.array([1, 2]), np.array([7, 9]), np.array([3])]
    s = packing.Bm25Shard(t, [np.ones(len(x)) for x in t], idf, 2.0).scores([0])[0]
    assert s[2] > s[1] > 0 == s[3]


def test_scores_of_a_part_and_of_frequent_terms():
    rng = np.random.default_rng(2)
    terms = [np.unique(rng.integers(1, 400, rng.integers(1, 60)) ** 2 % 900 + 1) for _ in range(90)]
    tf = [rng.integers(1, 9, len(t)) for t in terms]
    idf = rng.random(packing.TERMS).astype(np.float32)
    length = np.array([t.sum() for t in tf])
    weight = [idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / length.mean())) for t, f, n in zip(terms, tf, length)]
    want = np.array([[sum(w for t, w in zip(terms[d], weight[d]) if t in set(terms[q])) for d in range(90)] for q in range(90)])
    for dense in (1, 8, 10_000):
        index = packing.Bm25Shard(terms, tf, idf, length.mean(), dense=dense)
        assert np.allclose(index.scores(list(range(90))), want, atol=1e-3)
        some = np.array([7, 3, 80, 41])
        assert np.allclose(index.of(some).scores([5, 80]), want[[5, 80]][:, some], atol=1e-3)


def test_split_of_latin_texts():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(chr(rng.choice([32, 39, 116, rng.randrange(256), rng.randrange(97, 123)])) for _ in range(rng.randrange(1, 40)))
        assert packing.split(t) == packing._SPLIT.findall(t), repr(t)


def test_tree_is_exact():
    quotas = np.array([1000, 7, 0, 333])
    for n in (1, 2, 3, 7, 16):
        dealt = mixing.split_tree(quotas, n, 5)
        assert (dealt.sum(0) == quotas).all() and dealt.sum(1).max() - dealt.sum(1).min() <= 2 * n.bit_length() and (dealt >= 0).all()
    assert (mixing.split_tree(quotas, 7, 5) == mixing.split_tree(quotas, 7, 5)).all()


@pytest.mark.parametrize("blocks", [1, 8])
def test_shares_and_repeats(spark, blocks):
    rows, df = docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 5), ("absent", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    df = df.where("length(text) < 5000 or text is null")
    drawn, report = mixing.mix_sources(df, targets, shard_tokens=3000, shard_blocks=blocks)
    drawn, report = drawn.collect(), {r.source: r for r in report.collect()}
    assert report["absent"].drawn_tokens == 0 and set(report) == {"a", "b", "c", "absent"}
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(report[s].actual_share - share) < 0.03
        assert 0 <= report[s].drawn_tokens - report[s].quota_tokens < 600
    most = {"a": 1, "b": 2, "c": 5}
    times, places = {}, set()
    for r in drawn:
        times.setdefault((r.source, r.doc_id), []).append(r.repeat_no)
        places.add((r.shard, r.position))
    assert all(len(v) == len(set(v)) and max(v) <= most[s] for (s, _), v in times.items()) and len(places) == len(drawn)
    again = mixing.mix_sources(df, targets, shard_tokens=3000, shard_blocks=blocks)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_ranges_of_the_tree_agree_with_the_whole():
    quotas = np.array([5000, 1, 77, 0])
    whole = mixing.split_tree(quotas, 1000, 3)
    assert (whole.sum(0) == quotas).all()
    for first, last in ((0, 1), (37, 401), (999, 1000)):
        for shard, before, have in mixing.split_range(quotas, 1000, 3, first, last):
            assert (have == whole[shard]).all() and (before == whole[:shard].sum(0)).all() and first <= shard < last


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 4096])
def test_stride_permutes(n):
    a, c = mixing.stride(n, 5)
    assert {(a * i + c) % n for i in range(n)} == set(range(n))


def test_a_thousand_shards(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9))), "big" if i % 3 else "small") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 2)], "source string, target_share double, max_repeats int")
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(df, ["doc_id"]).collect()}
    n = sum(sizes.values())
    drawn, report = mixing.mix_sources(df, targets, shard_tokens=n // 900, shard_blocks=4)
    rows, report = drawn.collect(), {r.source: r for r in report.collect()}
    per_shard = {}
    for r in rows:
        per_shard[r.shard] = per_shard.get(r.shard, 0) + r.n_tokens
    assert len(per_shard) > 850 and max(per_shard.values()) < 4 * n // 900  # blocks stay below a shard's size, so shards stay even
    assert all(0 <= r.drawn_tokens - r.quota_tokens < 60 for r in report.values()) and abs(report["big"].actual_share - 0.6) < 0.001
    assert len({(r.doc_id, r.repeat_no) for r in rows}) == len(rows) == len({(r.shard, r.position) for r in rows})


def test_mixing_nothing(spark):
    _, df = docs(spark, 5)
    targets = spark.createDataFrame([("zz", 1.0, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix_sources(df, targets)
    assert drawn.count() == 0 and report.first().actual_share == 0.0
    drawn, report = mixing.mix_sources(df.limit(0), targets.limit(0))
    assert drawn.count() == 0 and report.count() == 0


def test_neighbours_fill_before_size():
    # a seed, four small neighbours of falling score, and strangers of which one alone would close the gap
    terms = [np.array([1, 2, 3, 4]), np.array([1, 2, 3, 4]), np.array([1, 2, 3]), np.array([1, 2]), np.array([1]), np.array([9]), np.array([9])]
    sizes = np.array([60, 10, 10, 10, 9, 40, 1])
    index = packing.Bm25Shard(terms, [np.ones(len(t)) for t in terms], np.ones(packing.TERMS, dtype=np.float32), 3.0)
    bins, n = packing.pack_shard(sizes, index, 100)
    assert n == 2 and list(bins) == [0, 0, 0, 0, 0, 1, 0]
