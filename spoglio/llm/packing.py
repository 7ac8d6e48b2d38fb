"""Filling containers of fixed capacity with documents by lexical retrieval.

One pass over the texts gives each document its size in tokens and its term frequencies, by hashed terms. Document
frequencies are summed over all documents (a vector of fixed width). Documents are spread by a hash of their
id over shards of about `shard_docs`, and every shard holds a BM25 inverted index of its own documents with the
global statistics. From the longest unused document on, each becomes the seed of a container: the index returns
its unused neighbours by BM25 score for all its terms, which are added greedily while they fit; what
space is left takes the largest unused documents that fit. A document longer than the capacity fills whole containers with its first
tokens and only the rest is packed with others.
"""

from __future__ import annotations

import copy
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoglio.llm.tokens import PATTERN, VOCABULARY, tokenizer
from spoglio.session import materialize

TERMS = 1 << 16
_SPLIT = regex.compile(PATTERN)
# the same pattern for texts of Latin-1 characters alone, whose letters, numbers and blanks plain classes can list
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_SPLIT_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def split(text: str) -> list[str]:
    """The pieces of the tokenizer's split pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _SPLIT.findall(text)
    return _SPLIT_LATIN.findall(text)


class _Pieces(dict):
    """Piece of the tokenizer's split pattern -> (number of tokens, hashed term or 0). Kept for each process,
    without pieces of digits, and emptied when it grows large."""

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        self.vocabulary, self.encode = vocabulary, tokenizer(vocabulary).encode_ordinary

    def __missing__(self, piece: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        word = piece.strip().lower()
        got = len(self.encode(piece)), (zlib.crc32(word.encode()) % (TERMS - 1) + 1 if len(word) > 1 and word.isalnum() else 0)
        if not word.isdigit():
            self[piece] = got
        return got


_pieces: dict[str, _Pieces] = {}


def measure(text: str | None, vocabulary: str = VOCABULARY) -> tuple[int, list[int], list[int]]:
    """(tokens, terms in order, their frequencies) of a whole text; the pieces of the split pattern are encoded
    independently by the tokenizer, so their token counts add up to the text's."""
    if not text:
        return 0, [], []
    pieces = _pieces.get(vocabulary) or _pieces.setdefault(vocabulary, _Pieces(vocabulary))
    n, terms = 0, {}
    for piece, times in Counter(split(text)).items():
        tokens, term = pieces[piece]
        n += tokens * times
        if term:
            terms[term] = terms.get(term, 0) + times
    order = sorted(terms)
    return n, order, [terms[t] for t in order]


class Bm25Shard:
    """Inverted index of one shard with global statistics. A document's query is all its terms. Terms in more than one of `dense`
    documents are kept as whole rows, whose sum costs less than walking their postings."""

    def __init__(self, terms: list[np.ndarray], tf: list[np.ndarray], idf: np.ndarray, avg_len: float, k1: float = 1.2, b: float = 0.75, dense: int = 16) -> None:
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        term = np.concatenate(terms) if len(terms) else np.zeros(0, int)
        f = (np.concatenate(tf) if len(tf) else np.zeros(0)).astype(np.float64)
        doc = np.repeat(np.arange(len(terms)), sizes)
        length = np.array([t.sum() for t in tf], dtype=np.float64)
        weight = idf[term] * f * (k1 + 1) / (f + k1 * (1 - b + b * length[doc] / max(avg_len, 1e-9)))
        order = np.argsort(term, kind="stable")
        self.n, self.doc, self.weight = len(terms), doc[order].astype(np.int32), weight[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(TERMS + 1))
        often = np.flatnonzero(np.diff(self.start) * dense > max(self.n, 1))
        row = np.full(TERMS, -1, dtype=np.int64)
        row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n), dtype=np.float32)
        for i, t in enumerate(often):
            self.rows[i, self.doc[self.start[t] : self.start[t + 1]]] = self.weight[self.start[t] : self.start[t + 1]]
        self.common = [row[t][row[t] >= 0] for t in terms]
        self.rare = [t[row[t] < 0] for t in terms]
        kept = row[term[order]] < 0  # postings of the other terms only
        self._keep(kept, self.doc)

    def _keep(self, kept: np.ndarray, doc: np.ndarray) -> None:
        self.start = np.concatenate([[0], np.cumsum(kept)])[self.start]
        self.doc, self.weight = doc[kept], self.weight[kept]

    def of(self, docs: np.ndarray) -> Bm25Shard:
        """The index of some of the documents, numbered as in `docs`; queries keep the numbers of this one."""
        out = copy.copy(self)
        place = np.full(self.n, -1, dtype=np.int32)
        place[docs] = np.arange(len(docs))
        out.n, out.rows = len(docs), np.ascontiguousarray(self.rows[:, docs])
        at = place[self.doc]
        out._keep(at >= 0, at)
        return out

    def scores(self, seeds: list[int]) -> np.ndarray:
        """The BM25 scores of every document of the index for the terms of each seed; 0 without a common one."""
        asked = np.zeros((len(seeds), len(self.rows)), dtype=np.float32)
        for i, seed in enumerate(seeds):
            asked[i, self.common[seed]] = 1
        out = asked @ self.rows
        rare = np.concatenate([self.rare[seed] for seed in seeds])
        start, size = self.start[rare], self.start[rare + 1] - self.start[rare]
        if total := int(size.sum()):
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)
            base = np.repeat(np.arange(len(seeds)) * self.n, [len(self.rare[seed]) for seed in seeds])
            out += np.bincount(np.repeat(base, size) + self.doc[at], self.weight[at], len(seeds) * self.n).reshape(out.shape)
        return out


def pack_shard(sizes: np.ndarray, index: Bm25Shard, capacity: int, ahead: int = 32) -> tuple[np.ndarray, int]:
    """(container number of each document's last part, number of containers). sizes: what is left to pack of each
    document, 1..capacity, or 0 for nothing. The seed's unused neighbours are taken in the order of score while
    they fit; a gap that none of them fits takes the largest unused documents that do.

    The next `ahead` seeds are scored at once, and the index is cut down to the unused documents whenever a quarter of it is used."""
    bins, n = np.full(len(sizes), -1, dtype=np.int64), 0
    alive = np.flatnonzero(sizes > 0)
    alive = alive[np.argsort(sizes[alive], kind="stable")]  # by size, so that documents that fit a gap lead
    seeds = alive[::-1]
    index, used = index.of(alive), 0
    size, free = sizes[alive], np.ones(len(alive), dtype=bool)
    scored: dict[int, np.ndarray] = {}
    last = len(alive) - 1

    def use(k: int) -> int:
        nonlocal used
        bins[alive[k]], free[k], used = n, False, used + 1
        return int(size[k])

    for at, seed in enumerate(seeds):
        if bins[seed] >= 0:
            continue
        if 4 * used > len(alive):
            kept = np.flatnonzero(free)
            index, alive, used, scored = index.of(kept), alive[kept], 0, {}
            size, free, last = sizes[alive], np.ones(len(alive), dtype=bool), len(alive) - 1
        while not free[last]:  # the seed is the largest document left
            last -= 1
        gap, smallest = capacity - use(last), int(size[0])
        if gap >= smallest:
            if int(seed) not in scored:
                batch = seeds[at : at + 4 * ahead]
                batch = [int(s) for s in batch[(bins[batch] < 0) | (batch == seed)][:ahead]]
                scored = dict(zip(batch, index.scores(batch)))
            scores = scored[int(seed)][: np.searchsorted(size, gap, "right")]
            near = np.flatnonzero((scores > 0) & free[: len(scores)])
            while len(near) and gap >= smallest:
                # the best few first; the others only if space is left after them
                few = near[np.argpartition(-scores[near], 64)[:64]] if len(near) > 96 else near
                for k in few[np.lexsort((few, -scores[few]))]:
                    if size[k] <= gap:
                        gap -= use(int(k))
                near = near[free[near] & (size[near] <= gap) & (len(few) < len(near))]
        while gap >= smallest:
            fits = np.flatnonzero(free[: np.searchsorted(size, gap, "right")])
            if not len(fits):
                break
            gap -= use(int(fits[-1]))
        n += 1
    return bins, n


PACKED = "container string, capacity int, shard int, bin int, doc_id long, part int, from_token long, n_tokens int"


def pack_documents(docs: DataFrame, containers: DataFrame, shard_docs: int = 4096, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, text) and containers (container, capacity_tokens) -> one row for each part of each document
    in each kind of container: container, capacity, shard, bin (from 0 in the shard), doc_id, part (from 0),
    from_token, n_tokens. Documents are cut only if they alone exceed the capacity, then into full containers and
    a rest. Null, empty and token-free texts take no space and give no row; rows of one doc_id count once, the largest;
    containers with a null name or without capacity above 0 are left out. Empty tables give no rows. Other columns are
    ignored.

    `containers` is a short list of kinds and is read by the driver, as is the vector of document frequencies.
    """
    kinds = sorted({(r.container, int(r.capacity_tokens)) for r in containers.select("container", "capacity_tokens").collect() if r.container is not None and (r.capacity_tokens or 0) > 0})

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [measure(t, vocabulary) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": [g[0] for g in got], "terms": [np.array(g[1], dtype="<u2").tobytes() for g in got], "tf": [np.array(g[2], dtype="<u4").tobytes() for g in got]})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    feats = materialize(source.mapInPandas(features, "doc_id long, n long, terms binary, tf binary").where("n > 0"), "pack-features")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, length = np.zeros(TERMS, dtype=np.int64), 0, 0
        for batch in batches:
            for terms, tf in zip(batch["terms"], batch["tf"]):
                df[np.frombuffer(terms, dtype="<u2")] += 1
                length += int(np.frombuffer(tf, dtype="<u4").sum())
                n += 1
        yield pd.DataFrame({"df": [df.tobytes()], "n": [n], "length": [length]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, length = np.zeros(TERMS, dtype=np.int64), 0, 0
        for batch in batches:
            for own in batch["df"]:
                df += np.frombuffer(own, dtype=np.int64)
            n, length = n + int(batch["n"].sum()), length + int(batch["length"].sum())
        yield pd.DataFrame({"df": [df.tobytes()], "n": [n], "length": [length]})

    # each task gives one vector; a few tasks add them up, so that as many reach the driver at any size
    row = "df binary, n long, length long"
    df, n_docs, length = np.zeros(TERMS, dtype=np.int64), 0, 0
    for r in feats.mapInPandas(frequencies, row).repartition(8).mapInPandas(add, row).toLocalIterator():
        df += np.frombuffer(r.df, dtype=np.int64)
        n_docs, length = n_docs + r.n, length + r.length
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    avg_len, n_shards = length / max(n_docs, 1), max(1, math.ceil(n_docs / shard_docs))

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["doc_id", "n"]).drop_duplicates("doc_id", keep="last")
        n = batch["n"].to_numpy()
        ids, shard = batch["doc_id"].to_numpy(), int(batch["shard"].iloc[0])
        index = Bm25Shard([np.frombuffer(t, dtype="<u2").astype(np.int64) for t in batch["terms"]], [np.frombuffer(t, dtype="<u4") for t in batch["tf"]], idf, avg_len)
        out = []
        for name, capacity in kinds:
            full, rest = n // capacity, n % capacity
            bins, used = pack_shard(rest, index, capacity)
            own = np.flatnonzero(rest)
            out.append(pd.DataFrame({"container": name, "capacity": capacity, "bin": bins[own], "doc_id": ids[own], "part": full[own], "from_token": full[own] * capacity, "n_tokens": rest[own]}))
            if full.sum():
                doc = np.repeat(np.arange(len(n)), full)
                part = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
                out.append(pd.DataFrame({"container": name, "capacity": capacity, "bin": used + np.arange(len(doc)), "doc_id": ids[doc], "part": part, "from_token": part * capacity, "n_tokens": capacity}))
        rows = pd.concat(out) if out else pd.DataFrame(columns=["container", "capacity", "bin", "doc_id", "part", "from_token", "n_tokens"])
        return rows.assign(shard=shard)[["container", "capacity", "shard", "bin", "doc_id", "part", "from_token", "n_tokens"]]

    sharded = feats.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(pack, PACKED)


def fill_report(packed: DataFrame) -> DataFrame:
    """For each kind of container: containers used, tokens packed, the share of space filled, and the least number
    of containers that could hold the tokens."""
    bins = packed.groupBy("container", "capacity", "shard", "bin").agg(F.sum("n_tokens").alias("used"))
    total = F.sum("used")
    return bins.groupBy("container", "capacity").agg(F.count("*").alias("n_containers"), total.alias("n_tokens"), (total / (F.count("*") * F.first("capacity"))).alias("fill"), F.ceil(total / F.first("capacity")).cast("long").alias("least_containers"))
