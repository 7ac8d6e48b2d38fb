"""Languages of documents and of their stretches: nearest centroid over TF-IDF n-gram vectors.

Every paragraph (part of the text between blank lines) becomes a normalised TF-IDF vector of hashed
character n-grams and words, folded to unaccented lower case. Each language has several centroids, found by
spherical k-means over labelled paragraphs; a paragraph takes the language of the nearest centroid by
cosine, unless the nearest is farther than the fitted distance, in which case it is rejected and takes the
language of the accepted paragraph before it (else after it).

Document frequencies are counted over all paragraphs of all documents. The centroids are fitted on a
bounded sample of labelled documents (about ``fit_docs``, never twice as many, chosen by a hash of the id); labels may be wrong, so
after each round paragraphs nearer to another language's centroids are set aside.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("it", "en", "fr", "de", "es")
DIMS = 1024
BLOCK = 256
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"\n[ \t]*\n\s*")


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class _Vocabulary(dict):
    """Piece of text between spaces -> number; the features of piece k are flat[start[k] : start[k] + size[k]].
    One for each process; emptied when it grows large. Pieces without letters are all number 0, without features;
    pieces that hold digits, hardly any of which come again, are not kept."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.start, self.size = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.flat, self.used = np.zeros(16_384, dtype=np.int64), 0

    def __missing__(self, word: str) -> int:
        letters = _WORD.findall(word)
        if not letters or not word.isalpha() and any(c.isdigit() for c in word):
            return 0
        ids, k = [], len(self)
        for w in (f"_{fold(x)}_" for x in letters):
            ids += [zlib.crc32(g.encode()) & (DIMS - 1) for g in [w, *(w[i : i + 3] for i in range(len(w) - 2))]]
        if k == len(self.start):
            self.start, self.size = np.resize(self.start, 2 * k), np.resize(self.size, 2 * k)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[k], self.size[k] = self.used, len(ids)
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self[word] = k
        return k


_vocabulary = _Vocabulary()


def paragraphs(text: str | None) -> list[str]:
    """The parts of a text between blank lines, whole; none for a null or blank text."""
    return [p for p in _BREAK.split(text.strip("\n")) if p.strip()] if text else []


def counts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of feature counts for each text, its number of words)"""
    global _vocabulary
    if len(_vocabulary) > 300_000:
        _vocabulary = _Vocabulary()
    v = _vocabulary
    found = [p.lower().split() for p in parts]
    pieces = np.fromiter(map(len, found), dtype=np.int64, count=len(parts))
    ids = np.fromiter(map(v.__getitem__, itertools.chain.from_iterable(found)), dtype=np.int64, count=int(pieces.sum()))
    owner = np.repeat(np.arange(len(parts)), pieces)
    words = np.bincount(owner[ids > 0], minlength=len(parts))
    key, times = np.unique((owner << 32 | ids)[ids > 0], return_counts=True)
    word, size = key & 0xFFFFFFFF, v.size[key & 0xFFFFFFFF]
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(v.start[word] - first, size)
    cell = np.repeat((key >> 32) * DIMS, size) + v.flat[at]
    flat = np.bincount(cell, weights=np.repeat(times, size), minlength=len(parts) * DIMS)
    return flat.reshape(len(parts), DIMS).astype(np.float32), words


def vectors(parts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, words = counts(parts)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm == 0, 1, norm)[:, None]
    return x, words


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(in how many documents each feature occurs, number of documents), over all documents. Each task sends
    one row of fixed width."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            texts = [t for t in batch[text] if t]
            n += len(texts)
            for i in range(0, len(texts), BLOCK):
                df += (counts(texts[i : i + BLOCK])[0] > 0).sum(0)
        yield pd.DataFrame({"df": [df.tolist()], "n": [n]})

    each = docs.select(text).mapInPandas(count, "df array<long>, n long")
    entries = F.expr("concat(df, array(n))")
    df = np.zeros(DIMS + 1, dtype=np.int64)
    for r in each.select(F.posexplode(entries).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        df[r.i] = r.v
    return df[:DIMS], int(df[DIMS])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(labelled: pd.DataFrame, idf: np.ndarray, per_language: int = 3, rounds: int = 3) -> dict:
    """Centroids from rows (text, lang) whose labels may be partly wrong.

    Every row's label stands for all its paragraphs. Returns centroids, their languages and the least
    cosine that is accepted: half of what all but one in a hundred fitted paragraphs reach.
    """
    parts, lang = [], []
    for t, l in zip(labelled["text"], labelled["lang"]):
        own = [p for p in paragraphs(t) if len(_WORD.findall(p)) >= 6]
        parts += own
        lang += [l] * len(own)
    if not parts:
        return {"centroids": np.zeros((0, DIMS)), "lang": [], "least": 1.0}
    x = np.concatenate([vectors(parts[i : i + BLOCK], idf)[0] for i in range(0, len(parts), BLOCK)])
    lang, keep = np.array(lang), np.ones(len(parts), dtype=bool)
    for _ in range(rounds):
        cs, names = [], []
        for l in sorted(set(lang)):
            own = x[keep & (lang == l)]
            if len(own):
                c = _kmeans(own, per_language)
                cs.append(c)
                names += [l] * len(c)
        centroids, names = np.concatenate(cs), np.array(names)
        cos = x @ centroids.T
        keep = names[cos.argmax(1)] == lang
        if not keep.any():
            keep[:] = True
    least = float(np.quantile(cos.max(1)[keep], 0.01)) * 0.5
    return {"centroids": centroids.astype(np.float32), "lang": names.tolist(), "least": least}


def classify(parts: list[str], idf: np.ndarray, model: dict, min_words: int = 3) -> list[tuple[str | None, float]]:
    """(language or None if rejected, confidence) of each paragraph. The confidence is the nearest language's
    share of the two nearest languages' cosines."""
    names, out = np.array(model["lang"]), []
    if not len(names):
        return [(None, 0.0)] * len(parts)
    order = sorted(set(model["lang"]))
    for i in range(0, len(parts), BLOCK):
        x, words = vectors(parts[i : i + BLOCK], idf)
        cos = x @ model["centroids"].T
        best = np.stack([cos[:, names == l].max(1) for l in order], 1)
        top = best.argmax(1)
        if len(order) > 1:
            two = np.sort(best, 1)[:, -2:]
            conf = two[:, 1] / np.maximum(two.sum(1), 1e-9)
        else:
            conf = best[:, 0]
        for j in range(len(x)):
            ok = words[j] >= min_words and best[j, top[j]] >= model["least"]
            out.append((order[top[j]] if ok else None, float(conf[j]) if ok else 0.0))
    return out


def stretches(found: list[tuple[str | None, float]], sizes: list[int]) -> list[tuple[int, int, str, float, int]]:
    """Longest runs of one language as (first paragraph, last, language, confidence, size). A rejected
    paragraph goes with the accepted one before it, at the start with the first accepted one."""
    known = [l for l, _ in found if l]
    if not known:
        return []
    runs, now = [], known[0]
    for k, ((l, conf), n) in enumerate(zip(found, sizes), 1):
        now = l or now
        if not runs or runs[-1][2] != now:
            runs.append([k, k, now, 0.0, 0])
        runs[-1][1] = k
        runs[-1][3] += conf * n
        runs[-1][4] += n
    return [(a, b, l, c / max(n, 1), n) for a, b, l, c, n in runs]


def label_code(label: str | None) -> str | None:
    return label[:2].lower() if label is not None else None


SCHEMA = "doc_id long, label string, doc_lang string, doc_confidence double, n_runs int, para_from int, para_to int, lang string, confidence double"


def identify_languages(docs: DataFrame, fit_docs: int = 3000, per_language: int = 3) -> DataFrame:
    """One row for each stretch of one language in each document of (doc_id, text, lang).

    Result: doc_id, label (as given), doc_lang and doc_confidence (of the language with most text, ties to
    the first), n_runs, para_from, para_to (from 1), lang, confidence. A null or empty text, and one in
    which every paragraph is rejected (bare numbers, unknown languages), gives one row with doc_lang, lang
    and the paragraph numbers null and n_runs 0. Repeated rows are each answered. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    df, n = document_frequencies(docs)
    idf = (np.log((n + 1) / (df + 1)) + 0.05).astype(np.float32)
    sample = (
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < fit_docs)
        .withColumn("lang", F.lower(F.substring("lang", 1, 2)))
        .where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
        .limit(2 * fit_docs)
        .select("text", "lang")
        .toPandas()
    )
    model = fit(sample, idf, per_language)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, part, owner = [], [], []
            texts = list(batch["text"])
            for k, t in enumerate(texts):
                own = paragraphs(t)
                part += own
                owner += [k] * len(own)
            found: list[list] = [[] for _ in texts]
            for k, p, f in zip(owner, part, classify(part, idf, model)):
                found[k].append((f, len(p)))
            for doc, label, own in zip(batch["doc_id"], batch["lang"], found):
                runs = stretches([f for f, _ in own], [n for _, n in own])
                if not runs:
                    rows.append((doc, label, None, 0.0, 0, None, None, None, 0.0))
                    continue
                total: dict[str, list[float]] = {}
                for _, _, l, c, n in runs:
                    have = total.setdefault(l, [0, 0.0])
                    have[0] += n
                    have[1] += c * n
                main = max(total, key=lambda l: total[l][0])
                conf = total[main][1] / max(total[main][0], 1)
                rows += [(doc, label, main, conf, len(runs), a, b, l, c) for a, b, l, c, _ in runs]
            out = pd.DataFrame(rows, columns=["doc_id", "label", "doc_lang", "doc_confidence", "n_runs", "para_from", "para_to", "lang", "confidence"])
            yield out.astype({"para_from": "Int32", "para_to": "Int32"})

    return docs.mapInPandas(answer, SCHEMA)


def mislabelled(found: DataFrame) -> DataFrame:
    """The stretches of documents whose label is missing or wrong or which mix languages."""
    wrong = F.col("label").isNull() | (F.lower(F.substring("label", 1, 2)) != F.col("doc_lang")) | (F.col("n_runs") > 1)
    return found.where(F.col("lang").isNotNull() & wrong).select("doc_id", "para_from", "para_to", "lang")
