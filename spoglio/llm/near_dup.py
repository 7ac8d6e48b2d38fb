"""Near-duplicate texts by BagMinHash signatures, banding and an exact overlap check.

Every text becomes a bag of word shingles, each with the number of its occurrences (or one, if sets are asked for). Exact copies (equal bags of words in order) are first folded into classes, of
which one representative goes on. A shingle's weight in the signature is its count, or 1/256 of that if it
occurs in more than one of `common_share` texts: phrases that everybody uses carry next to nothing, so that texts
which share only those seldom meet in a band there. Every text with a common shingle gets a second signature
without these weights, in as many bands one row longer, so that variants of a text that itself fills much of the
collection meet as well. A text without any needs none: it shares no common shingle with others, and the weights
can only raise its similarity. The BagMinHash signature of a weighted bag holds, for each
component, the least arrival time of the Poisson processes of its shingles, each over the interval from 0 to the
shingle's weight; the processes are made by splitting the process of the whole weight range in half
again and again, so that equal shingles of different weight share the points below the lesser weight (a range
of discretised weights). Two
signatures agree in a component with the probability of the weighted Jaccard similarity. Every text has the signature without those weights, two bits of
each component of which are its sketch: pairs that agree in fewer than a pair at the threshold would with a chance of all but one in a hundred thousand met by accident.
Sketches travel with the keys of the bands, so that such pairs, whose number grows with the square of the texts, end in the task where they meet.
The other pairs that agree in at least `min_hits` bands are checked exactly, by the overlap of the bags as they are.

Shingles are never written: a list of hashes takes several times the place of its compressed text. They are made from the texts for each of three passes, and texts,
not shingles, go to where their pairs are checked. Bands meet a few at a time, and the files of each step go as it ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoglio.session import discard, materialize

_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@cache
def _letters(planes: int) -> np.ndarray:
    """Of each code point of the first planes of 65,536, whether it is part of a word: a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(planes << 16)), dtype=bool, count=planes << 16)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, lower-cased, in order, and where each text's begin (one place more than texts)."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_word = _letters(1 if not len(code) or code.max() < 1 << 16 else 17)[code]
    edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    first, end = edge[::2], edge[1::2]
    size = end - first
    at = np.flatnonzero(is_word)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    each = mix(code[at].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(32)))
    hashes = mix(np.add.reduceat(each, np.cumsum(size) - size)) if len(size) else each
    begins = np.cumsum([0, *(len(t) + 1 for t in low)])
    return hashes, np.searchsorted(first, begins)


def shingles(texts: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """For each text (hashes of the different k-word shingles, in order; how often each occurs; number of words; hash of the sequence of words).
    Texts of fewer than k words have none."""
    i = 0
    while i < len(texts):
        j, chars = i + 1, len(texts[i])
        while j < len(texts) and chars < 50_000:
            chars += len(texts[j])
            j += 1
        h, at = words(texts[i:j])
        every = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
        for n in range(k):
            every = mix(every ^ h[n : n + len(every)])
        for lo, hi in zip(at, at[1:]):
            grams = np.sort(every[lo : max(lo, hi - k + 1)])
            new = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
            yield grams[new], np.diff(new, append=len(grams)), int(hi - lo), xxhash.xxh64_intdigest(h[lo:hi].tobytes())
        i = j


def repeats(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash for each occurrence of a shingle after its first; with the shingles themselves the bag as a set, so that its overlap with another is that of the bags."""
    more = counts - 1
    at = np.repeat(np.arange(len(grams)), more)
    number = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1
    return mix(grams[at] ^ mix(number.astype(np.uint64)))


#: Discretised weights: 0 and the powers of two from 1/256 to 1. A weight counts as the level at or above it.
LEVELS = np.concatenate([[0.0], 2.0 ** np.arange(-8, 1)])
#: The same with the counts of a bag: each up to 16, then a quarter more from level to level, to a million.
COUNT_LEVELS = np.concatenate([LEVELS, np.arange(2.0, 17.0), np.ceil(16 * 1.25 ** np.arange(1, 50))])


def bag_min_hash(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int, levels: np.ndarray = LEVELS) -> np.ndarray:
    """(n, m) signatures of n bags; item i with weights[i] belongs to bag owner[i].

    Each item has a Poisson process over all levels. A process knows the time of its next point only; to learn
    where that lies, the range is halved again and again: the half which holds the point inherits it, the
    other draws its own next point, and a half above the item's weight is dropped. At a single level the point is
    entered, in a component drawn at random, and the level goes on to its next point. A process whose next
    point is later than all entries of its bag can't change the signature and ends.
    """
    sig, width = np.full(n * m, np.inf), levels
    bag, need = owner.astype(np.int64), np.searchsorted(levels, weights, "left").clip(0, len(levels) - 1)
    node = mix(items.astype(np.uint64))
    lo, hi = np.zeros(len(node), dtype=np.int64), np.full(len(node), len(levels) - 1)
    t = -np.log(uniform(mix(node ^ np.uint64(1)))) / width[-1]
    go = need > 0
    bag, need, node, lo, hi, t = (v[go] for v in (bag, need, node, lo, hi, t))
    while len(node):
        leaf = hi - lo == 1
        at, when = node[leaf], t[leaf]
        np.minimum.at(sig, bag[leaf] * m + (mix(at ^ np.uint64(2)) % np.uint64(m)).astype(np.int64), when)
        at = mix(at ^ np.uint64(3))
        when = when - np.log(uniform(mix(at ^ np.uint64(4)))) / (width[hi[leaf]] - width[lo[leaf]])
        up, low, high = node[~leaf], lo[~leaf], hi[~leaf]
        mid = (low + high) // 2
        below, above = width[mid] - width[low], width[high] - width[mid]
        inherits = uniform(mix(up ^ np.uint64(5))) * (below + above) < below
        gap = -np.log(uniform(mix(up ^ np.uint64(6))))
        now = t[~leaf]
        bag = np.concatenate([bag[leaf], bag[~leaf], bag[~leaf]])
        need = np.concatenate([need[leaf], need[~leaf], need[~leaf]])
        node = np.concatenate([at, mix(up ^ np.uint64(7)), mix(up ^ np.uint64(8))])
        lo, hi = np.concatenate([lo[leaf], low, mid]), np.concatenate([hi[leaf], mid, high])
        t = np.concatenate([when, np.where(inherits, now, now + gap / below), np.where(inherits, now + gap / above, now)])
        go = (lo < need) & (t < sig.reshape(n, m).max(1)[bag])
        bag, need, node, lo, hi, t = (v[go] for v in (bag, need, node, lo, hi, t))
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(n, m // rows) keys of the bands, each of its band and row count alone."""
    bits = sig.view(np.uint64)
    n, m = bits.shape
    key = np.tile(mix(np.arange(m // rows, dtype=np.uint64) ^ np.uint64(rows << 32)), (n, 1))
    for i in range(rows):
        key = mix(key ^ bits[:, i : (m // rows) * rows : rows])
    return key


def band_parts(sig: np.ndarray, rows: int) -> np.ndarray:
    """The lower halves of the keys: two texts that agree in them by accident are told apart by their sketches and the exact check."""
    return band_keys(sig, rows).astype(np.uint32).view(np.int32)


def sketches(sig: np.ndarray) -> np.ndarray:
    """(n, m / 32) words with two bits of each component; what is left of the last word is the same in all."""
    n, m = sig.shape
    two = np.zeros((n, -(-m // 32) * 32), dtype=np.uint64)
    two[:, :m] = mix(sig.view(np.uint64) ^ np.uint64(9)) & np.uint64(3)
    return np.bitwise_or.reduce(two.reshape(n, -1, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=2)


def agreement(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """In how many of the m components the sketches of each row agree."""
    x = a ^ b
    differ = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return m - np.bitwise_count(differ).sum(1, dtype=np.int64)


def surely(similarity: float, m: int, risk: float = 1e-5) -> int:
    """The most of m components of a sketch in which two texts of that similarity agree with a chance of at least 1 - risk. Two bits are the same by accident in one of four."""
    p = min(similarity + (1 - similarity) / 4, 1 - 1e-12)
    total, k = 0.0, -1
    while total <= risk:
        k += 1
        total += math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log1p(-p))
    return k


def bucket_pairs(ids: np.ndarray, sketch: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: int, least: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket whose sketches agree in at least `least` components, some at a time, smaller id first."""

    def agreed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = agreement(sketch[a], sketch[b], m) >= least
        a, b = ids[a[near]], ids[b[near]]
        return np.minimum(a, b), np.maximum(a, b)

    for size in np.unique(sizes[(sizes > 1) & (sizes <= block)]):
        own = starts[sizes == size]
        a, b = np.triu_indices(size, 1)
        step = max(1, 200_000 // len(a))
        for i in range(0, len(own), step):
            yield agreed((own[i : i + step, None] + a).ravel(), (own[i : i + step, None] + b).ravel())
    for start, size in zip(starts[sizes > block], sizes[sizes > block]):
        for i in range(0, size, block):
            for j in range(i, size, block):
                a, b = (x.ravel() for x in np.meshgrid(np.arange(i, min(i + block, size)), np.arange(j, min(j + block, size)), indexing="ij"))
                yield agreed(start + a[a < b], start + b[a < b])


#: Bytes of keys with sketches that meet in one round, and the most rounds.
ROUND_BYTES, ROUNDS = 64 << 20, 10


def near_duplicates(records: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 1, bands: int = 48, rows: int = 4,
                    min_hits: int = 1, common_share: int = 20, bucket_block: int = 256, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the records' texts.

    members: id, class_id (least id among the exact copies), n_copies; one row for each record that counts. links: id_a < id_b
    of two classes whose bags of k-word shingles have a weighted Jaccard similarity (shared occurrences by all) of at least `threshold`, similarity;
    without `counted` each shingle counts once, as the different shingles of either text.
    Null texts, empty ones and texts of fewer than max(k, min_words) words don't count and have no row; repeated rows of one id count once (if
    texts differ under one id, the greater one). Copies are not linked to each other. Other columns are ignored. The records are read three times.

    A bucket is worked in blocks of `bucket_block` records. One of more than 16 blocks is cut into pieces of so many that meet
    piece by piece in different tasks, so no pair is lost and no task holds the bucket.
    """
    spark = records.sparkSession
    texts = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, size = [], 0, 0

        def often() -> pd.DataFrame:
            # what more than one text of common_share has is in more than one of them among some of these; half as often is kept for the sum
            g, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count > n / (2 * common_share)
            return pd.DataFrame({"id": pd.array([None] * int(keep.sum()), dtype="Int64"), "what": g[keep].view(np.int64), "count": count[keep]})

        for batch in batches:
            out = []
            for id_, (grams, _, length, copy) in zip(batch["id"], shingles(batch["text"].to_list(), k)):
                if length < max(k, min_words):
                    continue
                out.append((id_, copy))
                held.append(grams)
                n, size = n + 1, size + len(grams)
                if size > 1_000_000:
                    yield often()
                    held, n, size = [], 0, 0
            yield pd.DataFrame({"id": pd.array([x[0] for x in out], dtype="Int64"), "what": np.array([x[1] for x in out], dtype=np.uint64).view(np.int64), "count": 0})
        if held:
            yield often()

    seen = materialize(texts.mapInPandas(read, "id long, what long, count long"), "near-read", tidy=True)
    once = seen.where("id is not null").groupBy("id").agg(F.max("what").alias("copy"))
    classes = once.groupBy("copy").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    members = materialize(once.join(classes, "copy").select("id", "class_id", "n_copies", "copy"), "near-members", tidy=True)
    # one text for each class; an equal sequence of words has equal shingles, so any of the copies' will do
    chosen = members.where("id = class_id").select("id", F.col("copy").alias("chosen"))
    n = chosen.count()
    # about common_share times the mean number of shingles of a text at most. Which shingles these are decides how crowded the buckets get, not which pairs are found
    common = seen.where("id is null").groupBy("what").agg(F.sum("count").alias("n")).where(F.col("n") > max(n / common_share, 8)).select("what")
    common = np.sort(np.array([r.what for r in common.toLocalIterator()], dtype=np.int64))
    discard(seen)

    # a set has two weights only
    levels, plain_levels = (COUNT_LEVELS, COUNT_LEVELS) if counted else (LEVELS[[0, 1, -1]], LEVELS[[0, -1]])
    m = bands * (rows + 1)
    sketch = [f"s{i}" for i in range(-(-m // 32))]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.iloc[i : i + 128]
                got = [(id_, *g) for id_, g in zip(part["id"], shingles(part["text"].to_list(), k)) if g[2] >= max(k, min_words)]
                if not got:
                    continue
                flat = np.concatenate([g[1] for g in got])
                owner = np.repeat(np.arange(len(got)), [len(g[1]) for g in got])
                count = np.concatenate([g[2] for g in got]).astype(float) if counted else np.ones(len(flat))
                weight, often = count.copy(), np.zeros(len(flat), dtype=bool)
                if len(common):
                    often = common[np.minimum(np.searchsorted(common, flat.view(np.int64)), len(common) - 1)] == flat.view(np.int64)
                    weight[often] *= LEVELS[1]
                out = pd.DataFrame({"id": [g[0] for g in got], "copy": np.array([g[4] for g in got], dtype=np.uint64).view(np.int64)})
                out["keys"] = list(band_parts(bag_min_hash(flat, weight, owner, len(got), bands * rows, levels), rows))
                # no weights and one width for every text, as components of signatures of different widths don't compare
                sig = bag_min_hash(flat, count, owner, len(got), m, plain_levels)
                # what a text shares with its like may be just what is common, as in a large group of variants
                some = np.bincount(owner, weights=often, minlength=len(got)) > 0
                out["plain"] = [x if y else x[:0] for x, y in zip(band_parts(sig, rows + 1), some)]
                for c, x in zip(sketch, sketches(sig).view(np.int64).T):
                    out[c] = x
                yield out

    signed = texts.mapInPandas(sign, "id long, copy long, keys array<int>, plain array<int>, " + ", ".join(f"{c} long" for c in sketch))
    # joined by id alone, so that one shuffle serves the join and the removal of repeated rows
    signed = materialize(signed.join(chosen, "id").where("copy = chosen").dropDuplicates(["id"]).select("id", "keys", "plain", *sketch), "near-signed", tidy=True)

    # what the unweighted signatures tell at once of pairs that only met by chance; those of bags round counts over 16 up, by a quarter at most
    least, piece = surely(threshold / 1.25 if counted else threshold, m), 16 * bucket_block
    met_schema = "key long, id_a long, id_b long, " + ", ".join(f"{c} long" for c in sketch)

    def bare(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b), *[none] * len(sketch)], ["key", "id_a", "id_b", *sketch])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of their key the pairs within the buckets; the rows themselves, with their key, of buckets of more than a piece."""
        held, crowded = np.zeros((0, 2 + len(sketch)), dtype=np.int64), None

        def worked(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal crowded
            starts = np.flatnonzero(np.diff(x[:, 0], prepend=~x[:1, 0]))
            sizes = np.diff(starts, append=len(x))
            large = sizes > piece
            if crowded is not None and len(x) and x[0, 0] == crowded:
                large[0] = True
            own = np.repeat(large, sizes)
            if own.any():
                y = x[own]
                yield pa.RecordBatch.from_arrays([pa.array(y[:, 0]), pa.array(y[:, 1]), pa.nulls(len(y), pa.int64()), *(pa.array(y[:, 2 + i]) for i in range(len(sketch)))], ["key", "id_a", "id_b", *sketch])
                if large[-1]:
                    crowded = y[-1, 0]
            words_ = np.ascontiguousarray(x[:, 2:]).view(np.uint64)
            for a, b in bucket_pairs(x[:, 1], words_, starts[~large], sizes[~large], m, least, bucket_block):
                if len(a):
                    yield bare(a, b)

        for batch in batches:
            x = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            last = np.searchsorted(x[:, 0], x[-1, 0]) if len(x) else 0
            # a bucket goes when it is whole, or as soon as it is known to be crowded
            cut = len(x) if len(x) - last > piece or len(x) and crowded == x[-1, 0] else last
            yield from worked(x[:cut])
            held = x[cut:]
        yield from worked(held)

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of two pieces of a bucket, or within one."""
        for batch in batches:
            for ids_a, ids_b, sa, sb in zip(batch["ids_a"], batch["ids_b"], batch["sa"], batch["sb"]):
                sa, sb = (np.asarray(s, dtype=np.int64).view(np.uint64).reshape(-1, len(sketch)) for s in (sa, sb))
                ids_a, ids_b = np.asarray(ids_a), np.asarray(ids_b)
                for i in range(0, len(ids_a), max(1, 200_000 // len(ids_b))):
                    a, b = (x.ravel() for x in np.meshgrid(np.arange(i, min(len(ids_a), i + max(1, 200_000 // len(ids_b)))), np.arange(len(ids_b)), indexing="ij"))
                    near = agreement(sa[a], sb[b], m) >= least
                    yield pd.DataFrame({"id_a": ids_a[a[near]], "id_b": ids_b[b[near]]})

    each = max(1, n) * 2 * bands * (len(sketch) * 8 + 24)
    rounds = min(ROUNDS, bands, -(-each // ROUND_BYTES))
    parts, hits = [], []
    for r in range(rounds):
        lo, hi = bands * r // rounds, bands * (r + 1) // rounds
        of = F.posexplode(F.concat(F.slice("keys", lo + 1, hi - lo), F.slice("plain", lo + 1, hi - lo))).alias("band", "part")
        key = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("part").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        keyed = signed.select("id", *sketch, of).select(key.alias("key"), "id", *sketch)
        met = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, met_schema), "near-met", tidy=True)
        parts.append(met)
        hits.append(met.where("key is null").select("id_a", "id_b"))
        crowd = met.where("key is not null")
        size = crowd.groupBy("key").agg(F.count("*").alias("size"))
        if not size.isEmpty():
            # pieces of a bucket, each a row of its own, meet each other
            cut = crowd.join(size.withColumn("pieces", F.ceil(F.col("size") / piece).cast("int")), "key").withColumn("piece", F.pmod(F.xxhash64("id_a"), F.col("pieces")).cast("int"))
            cut = cut.groupBy("key", "piece", "pieces").agg(F.collect_list(F.struct("id_a", F.array(*sketch).alias("s"))).alias("own"))
            cut = cut.select("key", "piece", "pieces", F.col("own.id_a").alias("ids"), F.flatten("own.s").alias("s"))
            left = cut.select("key", "ids", "s", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).select("key", "piece", F.col("ids").alias("ids_a"), F.col("s").alias("sa"))
            squares = left.join(cut.select("key", "piece", F.col("ids").alias("ids_b"), F.col("s").alias("sb")), ["key", "piece"])
            more = materialize(squares.select("ids_a", "ids_b", "sa", "sb").mapInPandas(across, "id_a long, id_b long").where("id_a < id_b"), "near-across", tidy=True)
            parts.append(more)
            hits.append(more)
    every = hits[0]
    for other in hits[1:]:
        every = every.unionByName(other)
    pairs = materialize(every.groupBy("id_a", "id_b").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits).select("id_a", "id_b"), "near-pairs", tidy=True)
    discard(signed, *parts)

    # pairs are checked together with those of the same least neighbour, so that the text of a group's member travels once; large groups in squares
    home = pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("to")).unionByName(pairs.select("id_a", F.col("id_a").alias("to"))).groupBy("id_a").agg(F.min("to").alias("home"))
    homed = pairs.join(home, "id_a")
    size = homed.groupBy("home").agg(F.ceil(F.approx_count_distinct("id_b") / bucket_block).cast("int").alias("blocks"))
    side = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    homed = homed.join(size, "home").select("home", side("id_a").alias("row"), side("id_b").alias("col"), "id_a", "id_b")
    cell = ["home", "row", "col"]
    sent = homed.select(*cell, F.col("id_a").alias("id"), F.col("id_b").alias("to")).unionByName(homed.select(*cell, F.col("id_b").alias("id"), F.lit(None).cast("long").alias("to")))
    sent = materialize(sent.groupBy(*cell, "id").agg(F.collect_list("to").alias("to")).join(chosen, "id"), "near-sent", tidy=True)

    def overlaps(own: list[tuple[int, str, int, np.ndarray]]) -> Iterator[tuple[int, int, float]]:
        bags, to = {}, {}
        for (id_, _, copy, partners), (grams, count, _, now) in zip(own, shingles([x[1] for x in own], k)):
            if np.array(now, dtype=np.uint64).view(np.int64) == copy:
                bags[id_] = np.concatenate([grams, repeats(grams, count)]) if counted else grams
                to[id_] = partners
        for a, partners in to.items():
            for b in partners:
                both = len(np.intersect1d(bags[a], bags[b], assume_unique=True))
                if (similarity := both / (len(bags[a]) + len(bags[b]) - both)) >= threshold:
                    yield a, int(b), similarity

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, []
        for batch in batches:
            out = []
            for home_, row, col, *x in batch[[*cell, "id", "text", "chosen", "to"]].itertuples(index=False, name=None):
                if (home_, row, col) != at:
                    out.extend(overlaps(own))
                    at, own = (home_, row, col), []
                own.append(tuple(x))
            yield pd.DataFrame(out, columns=["id_a", "id_b", "similarity"])
        yield pd.DataFrame(list(overlaps(own)), columns=["id_a", "id_b", "similarity"])

    together = texts.join(sent, "id").repartition(*cell).sortWithinPartitions(*cell)
    links = materialize(together.mapInPandas(verify, "id_a long, id_b long, similarity double"), "near-links", tidy=True)
    discard(sent, pairs)
    return links, members.select("id", "class_id", "n_copies")


def record_pairs(links: DataFrame, members: DataFrame, copies: int | None = None, block: int = 256) -> DataFrame:
    """Pairs of records id_a < id_b: every record of one class with every record of a linked class, and the copies
    within a class among each other. With `copies`, the records of a class of more copies are not paired among each other but
    with its first one only. A class is cut into blocks of about `block` records that meet block by block in different tasks."""
    cut = members.withColumn("blocks", F.ceil(F.col("n_copies") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    size = cut.where("id = class_id").select("class_id", "blocks")
    every_block = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    meet = links.select("id_a", "id_b").join(size.select(F.col("class_id").alias("id_a"), F.col("blocks").alias("na")), "id_a").join(size.select(F.col("class_id").alias("id_b"), F.col("blocks").alias("nb")), "id_b")
    meet = meet.withColumn("block_a", every_block("na")).withColumn("block_b", every_block("nb"))
    a = cut.select(F.col("class_id").alias("id_a"), F.col("block").alias("block_a"), F.col("id").alias("a"))
    b = cut.select(F.col("class_id").alias("id_b"), F.col("block").alias("block_b"), F.col("id").alias("b"))
    across = meet.join(a, ["id_a", "block_a"]).join(b, ["id_b", "block_b"]).select("a", "b")
    many = cut.where("n_copies > 1")
    small = many if copies is None else many.where(F.col("n_copies") <= copies)
    left = small.select("class_id", "block", F.col("id").alias("a"))
    right = small.withColumn("block", every_block("blocks")).select("class_id", "block", F.col("id").alias("b"))
    within = left.join(right, ["class_id", "block"]).where("a < b").select("a", "b")
    every = across.unionByName(within)
    if copies is not None:
        every = every.unionByName(many.where((F.col("n_copies") > copies) & (F.col("id") != F.col("class_id"))).select(F.col("class_id").alias("a"), F.col("id").alias("b")))
    return every.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def components(links: DataFrame, members: DataFrame, rounds: int = 30) -> DataFrame:
    """One row for each record: id, class_id, n_links (of its class), group_id (the least class of its connected
    component). Labels spread along links and jump to their label's label, so long chains need few rounds;
    each round is written to the shared folder."""
    edges = materialize(links.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).unionByName(links.select(F.col("id_b").alias("u"), F.col("id_a").alias("v"))), "links")
    degree = edges.groupBy("u").agg(F.count("*").alias("n_links"))
    label = materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    for _ in range(rounds):
        near = edges.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        new = label.join(near, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("u").alias("label"), F.col("label").alias("up"))
        new = materialize(new.join(jump, "label", "left").select("u", F.coalesce(F.least("up", "label"), "label").alias("label"), "old"), "labels")
        moved = new.where("label <> old").limit(1).count()
        label = new.select("u", "label")
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = members.join(label.withColumnRenamed("u", "class_id"), "class_id", "left").join(degree.withColumnRenamed("u", "class_id"), "class_id", "left")
    return out.select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "class_id").alias("group_id"))
