"""Repairing text from scanned pages: words cut at line ends, misread words, page furniture.

Two passes over the texts. The first counts in how many texts each word and each pair of neighbouring words occurs, and
once more with every different line in one text only, so that copies and variants of a scan don't vouch for their own
errors; a word is wrong if either count says so. Words in at least `known_share` of the texts are the vocabulary, whose size the mean number of words of a text bounds.
From it the models are trained, without any labels: known words are cut and misread at random, and lines whose form
leaves no doubt teach what furniture looks like. The second pass classifies pairs of lines (furniture, joins)
and lists the suspects, words much rarer than the vocabulary. The suspects' correction candidates come from an
inverted join on the rarest character q-grams of both sides; gradient-boosted trees rank the candidates by form and by the neighbouring
words and decide whether any replaces the suspect, or closes the gap inside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoglio.llm.boosting import Boosted
from spoglio.session import materialize

_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_CUT = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)*|[^\W_]*[^\W\d_][^\W_]*)[-¬­‐]\s*$")
_HEAD = re.compile(r"\s*([^\W_]+(?:-[^\W_]+)*)")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|\*\*.*\*\*\s*$)")
# Characters that scanning takes for each other.
CONFUSED = (
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("nn", "m"), ("in", "m"), ("l", "1"), ("i", "1"), ("i", "l"), ("o", "0"), ("s", "5"), ("b", "6"), ("g", "9"), ("z", "2"), ("e", "c"), ("a", "à"), ("e", "è"),
    ("i", "ì"), ("o", "ò"), ("u", "ù"), ("t", "f"), ("a", "o"), ("u", "n"), ("h", "b"), ("t", "l"), ("i", "t"), ("i", "j"), ("n", "r"), ("v", "y"), ("q", "g"), ("f", "t"), ("c", "e"), ("o", "c"), ("a", "e"),
)
_FORMS = {c: i for i, pair in enumerate(CONFUSED) for c in (pair, pair[::-1])}


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 2] for i in range(len(w) - 1)]


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> tuple[float, int]:
    """(weighted, plain) least cost of turning a into b, where confused characters cost less than others."""
    rows = [[(0.0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0:
                continue
            options = []
            if i:
                options.append((rows[i - 1][j][0] + (0.3 if a[i - 1] == " " else 1), rows[i - 1][j][1] + 1))
            if j:
                options.append((rows[i][j - 1][0] + 1, rows[i][j - 1][1] + 1))
            if i and j:
                same = a[i - 1] == b[j - 1]
                near = 0.3 if (a[i - 1], b[j - 1]) in _FORMS else 1.0
                options.append((rows[i - 1][j - 1][0] + (0 if same else near), rows[i - 1][j - 1][1] + (not same)))
            for x, y in ((1, 2), (2, 1)):
                if i >= x and j >= y and (a[i - x : i], b[j - y : j]) in _FORMS:
                    options.append((rows[i - x][j - y][0] + 0.3, rows[i - x][j - y][1] + 1))
            rows[i][j] = min(options)
    return rows[-1][-1]


class Language:
    """Vocabulary and neighbouring pairs with their shares of all texts, or of those that have lines of their own."""

    def __init__(self, words: dict[str, float], pairs: dict[tuple[str, str], float], frequent: float = 0.05) -> None:
        self.words, self.pairs = words, pairs
        # words in so many texts are neither suspects nor both parts of a gapped word
        self.frequent = frozenset(w for w, share in words.items() if share >= frequent and w.isalpha())

    def share(self, word: str) -> float:
        return math.log10(self.words.get(word, 0.0) + 1e-6)

    def features(self, suspect: str, share: float, candidate: str, before: str, after: str) -> list[float]:
        """Of replacing a suspect word by a candidate between two words."""
        d, plain = distance(suspect, candidate)
        common = len(set(grams(suspect)) & set(grams(candidate)))
        left, right = self.pairs.get((before, candidate), 0.0), self.pairs.get((candidate, after), 0.0)
        return [
            d, plain, d / max(len(candidate), 1), len(candidate), len(suspect) - len(candidate), common / (len(candidate) + 1), self.share(candidate), self.share(candidate) - math.log10(share + 1e-6),
            math.log10(left + 1e-6) - self.share(candidate), math.log10(right + 1e-6) - self.share(candidate), math.log10(max(left, right) + 1e-6), float(any(c.isdigit() for c in suspect)), float(" " in suspect),
        ]


def misread(word: str, rng: np.random.Generator) -> str:
    """The word with one or two characters taken for others."""
    for _ in range(1 + (rng.random() < 0.15)):
        options = [(i, a, b) for pair in CONFUSED for a, b in (pair, pair[::-1]) for i in range(len(word)) if word.startswith(a, i)]
        if options and rng.random() < 0.8:
            i, a, b = options[rng.integers(len(options))]
            word = word[:i] + b + word[i + len(a) :]
        else:
            i = int(rng.integers(len(word)))
            letter = "abcdefghilmnopqrstuvz"[rng.integers(21)]
            word = (word[:i] + letter + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + letter + word[i:])[rng.integers(3)]
    return word


class Index:
    """q-gram index of the vocabulary in memory, for training; the texts' suspects are joined in Spark."""

    def __init__(self, words: list[str]) -> None:
        self.words, where = words, {}
        self.length = np.array([len(w) for w in words])
        for n, w in enumerate(words):
            for g in set(grams(w)):
                where.setdefault(g, []).append(n)
        self.where = {g: np.array(ns) for g, ns in where.items()}

    def near(self, word: str) -> list[str]:
        hits = [self.where[g] for g in set(grams(word)) if g in self.where]
        if not hits:
            return []
        common, longest = np.bincount(np.concatenate(hits), minlength=len(self.words)), np.maximum(self.length, len(word))
        good = (common >= 1) & (np.abs(self.length - len(word)) <= 2) & (common >= longest + 1 - np.where(longest > 5, 4, 3))
        return [self.words[n] for n in np.flatnonzero(good)]


def least_common(length: int) -> int:
    """How many q-grams a word of that length shares at least with any candidate: two confusions or fewer; short words must be close."""
    return length + 1 - (4 if length > 5 else 3)


def prefix(word: str, rank: dict[str, int]) -> list[str]:
    """The rarest q-grams of a word, so many that a candidate which shares enough of all shares one of these (and the other way round)."""
    own = sorted(set(grams(word)), key=lambda g: (rank.get(g, -1), g))
    return own[: max(1, len(own) - max(1, least_common(len(word))) + 1)]


def train_ranker(lang: Language, sample: int = 4000, seed: int = 3) -> Boosted:
    """On at most `sample` known words in a known neighbourhood, misread at random or with a stray gap inside, as many known words left out of
    the vocabulary, which nothing must replace, and neighbouring known words that would make a third."""
    rng = np.random.default_rng(seed)
    pairs = sorted(lang.pairs, key=lambda p: (-lang.pairs[p], p))[: 20 * sample]
    known = [w for w in sorted(lang.words) if len(w) > 2 and w.isalpha()]
    index, after = Index(known), {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    x, y = [], []
    weights = np.array([lang.pairs[p] for p in pairs])
    picks = rng.choice(len(pairs), size=sample, p=weights / weights.sum()) if len(pairs) else []
    for n in picks:
        before, word = pairs[n]
        follow = after.get(word, [""])
        nxt = follow[rng.integers(len(follow))]
        if len(word) < 3 or not word.isalpha():
            continue
        for suspect, right in ((misread(word, rng), word), (known[rng.integers(len(known))], None)):
            if right is not None and suspect in lang.words:
                continue
            if right is None:
                suspect = suspect[::-1] if rng.random() < 0.3 else suspect
            share = 10.0 ** rng.uniform(-5, -2.7)
            for c in index.near(suspect):
                if c == suspect:
                    continue
                x.append(lang.features(suspect, share, c, before, nxt))
                y.append(c == right)
        # gaps in words of this neighbourhood, and in any word between any others
        for w, left, right in ((word, before, nxt), (known[rng.integers(len(known))], pairs[rng.integers(len(pairs))][0], pairs[rng.integers(len(pairs))][1])):
            if len(w) > 4:
                i = int(rng.integers(1, len(w)))
                x.append(lang.features(f"{w[:i]} {w[i:]}", 10.0 ** rng.uniform(-5, math.log10(lang.words[w]) - 0.7), w, left, right))
                y.append(True)
    # parts far rarer than the whole are a gap that many texts repeat, not two words
    whole = [(a, b) for a, b in sorted(lang.pairs) if len(a + b) > 4 and 0 < lang.words.get(a + b, 0.0) < 20 * min(lang.words.get(a, 0.0), lang.words.get(b, 0.0))]
    for a, b in whole[: sample // 4]:
        for _ in range(1 + sample // (8 * len(whole))):
            before, nxt = pairs[rng.integers(len(pairs))][0], pairs[rng.integers(len(pairs))][1]
            x.append(lang.features(f"{a} {b}", min(lang.words.get(a, 0.0), lang.words.get(b, 0.0)), a + b, before, nxt))
            y.append(False)
    return Boosted().fit(np.array(x), np.array(y)) if x and any(y) and not all(y) else Boosted(rounds=0).fit(np.zeros((1, 13)), np.zeros(1))


def join_features(lang: Language, left: str, right: str) -> list[float]:
    """Of reading a word cut at a line end with a hyphen of its own."""
    whole, kept = (left + right).lower(), f"{left}-{right}".lower()
    return [lang.share(whole), lang.share(kept), lang.share(left.lower()), lang.share(right.lower()), len(left), len(right)]


def train_joins(lang: Language, sample: int = 3000, seed: int = 5) -> Boosted:
    """Known words cut at random, and known compounds cut at their hyphen."""
    rng = np.random.default_rng(seed)
    plain = [w for w in sorted(lang.words) if w.isalpha() and len(w) > 4]
    compound = [w for w in sorted(lang.words) if "-" in w and not any(c.isdigit() for c in w)]
    x, y = [], []
    for _ in range(sample if plain else 0):
        w = plain[rng.integers(len(plain))]
        i = int(rng.integers(2, len(w) - 1))
        x.append(join_features(lang, w[:i], w[i:]))
        y.append(0)
        if compound:
            w = compound[rng.integers(len(compound))]
            i = w.index("-")
            x.append(join_features(lang, w[:i], w[i + 1 :]))
            y.append(1)
    return Boosted(rounds=20).fit(np.array(x), np.array(y)) if x else Boosted(rounds=0).fit(np.zeros((1, 6)), np.zeros(1))


_OPENING = re.compile(r"(?:fascicolo|proc\.|procedimento|r\.g\.|n\.)", re.IGNORECASE)
_PAGED = re.compile(r"\bpag\.?\s*[\dlIO]+$")
_NUMBER_LINE = re.compile(r"\s*(?:[-–\[(]?\s*[\dlIO]{1,4}\s*[-–\])]?|(?:pag(?:ina|\.)?|p\.|f\.|fol\.|foglio)\s*[\dlIO]{1,4}(?:\s*(?:di|/|su)\s*[\dlIO]{1,4})?)\s*", re.IGNORECASE)
_SURE = re.compile(r"\s*(?:pag(?:ina|\.)\s*\d+(?:\s*(?:di|/)\s*\d+)?|[-–]\s*\d+\s*[-–]|\[\d+\])\s*", re.IGNORECASE)


_HEADER = re.compile(
    r"(?:[A-ZÀ-Ý][A-ZÀ-Ý' ]+ / .*\d.*|(?:fascicolo|fasc\.) [\dlIOo]+ - \S.*|proc\. .*\d.* - .*|(?:[Nn]\.|prot\.|PROT\.|R\.G\.|PROC\.)? ?[\dlIO]+(?:-[\dlIO]+)?/[\dlIO]{2,4}(?: R\.G\.N\.R\.)? - \S.*"
    r"|\S.{3,60} - (?:n\.|prot\.|r\.g\.)? ?[\dlIO]+(?:-[\dlIO]+)?/[\dlIO]{2,4}(?: r\.g\.n\.r\.)?(?: - pag\.? ?[\dlIO]+)?|\S.{3,70} - pag\.? ?[\dlIO]+)",
    re.IGNORECASE,
)


def header(text: str) -> bool:
    """Whether a line has the form of a running header: parts set off by dashes or strokes, one of them a number, no sentence."""
    return len(text) < 85 and (" - " in text or " / " in text) and (text[-1] not in ".,;:" or text.upper().endswith("R.G.N.R.")) and text[0] not in "-*#" and bool(_HEADER.fullmatch(text))


def line_features(lines: list[str], shares: dict[str, float] | None = None) -> list[list[float] | None]:
    """Of each line against its neighbours; None for empty lines."""
    masks = [re.sub(r"\d+", "#", l.strip()) for l in lines]
    times = Counter(m for m in masks if m)
    filled = [i for i, m in enumerate(masks) if m]
    place = {i: k for k, i in enumerate(filled)}
    title = re.sub(r"^[#* ]+", "", lines[filled[0]]).strip().lower() if filled else ""
    widest = max((len(l) for l in lines), default=1)
    number = [0 < len(m) < 30 and bool(_NUMBER_LINE.fullmatch(l)) for l, m in zip(lines, masks)]
    out: list[list[float] | None] = []
    for i, line in enumerate(lines):
        text = line.strip()
        if not text:
            out.append(None)
            continue
        k = place[i]
        up = filled[k - 1] if k else None
        down = filled[k + 1] if k + 1 < len(filled) else None
        before, after = lines[up].strip() if up is not None else "", lines[down].strip() if down is not None else ""
        letters, capitals, digits = sum(map(str.isalpha, text)), sum(map(str.isupper, text)), sum(map(str.isdigit, text))
        lower_next = float(bool(after) and (after[0].islower() or after[0].isdigit()))
        out.append([
            len(text), len(text) / widest, digits / len(text), capitals / max(letters, 1), float(text[-1] in ".;:,"), float(number[i]),
            float(up is not None and number[up]), float(down is not None and number[down]), float(k < 2), float(up is None), float(down is None),
            float(up is not None and i - up == 1), float(down is not None and down - i == 1), float(bool(before) and before[-1] not in ".;:!?*"), lower_next,
            min(times[masks[i]], 5), float("ag" in text[-12:] and bool(_PAGED.search(text[-12:]))), float(" - " in text or " / " in text), float("/" in text and bool(re.search(r"\d/\d{2,4}", text))),
            float(text[0] in "#*" and bool(_HEADING.match(line))), float(text[0].islower()), len(text.split()), float(text[0] in "FfPpRrNn" and bool(_OPENING.match(text))),
            float(header(text)), float(k > 1 and text.lower().startswith(title)),
        ])
    return out


def seed_lines(lines: list[str]) -> list[tuple[int, bool]]:
    """Lines whose kind is beyond doubt: page numbers spelt out; running headers by their form, the title line in capitals further down; against them full lines of prose, headings, title lines and ends of sentences."""
    filled = [i for i, l in enumerate(lines) if l.strip()]
    title = re.sub(r"^[#* ]+", "", lines[filled[0]]).strip().lower() if filled else ""
    sure = {i for i in filled if _SURE.fullmatch(lines[i])}
    numbers = {i for i in filled if _NUMBER_LINE.fullmatch(lines[i])}
    out = []
    for k, i in enumerate(filled):
        text = lines[i].strip()
        beside = (k > 0 and filled[k - 1] in numbers) or (k + 1 < len(filled) and filled[k + 1] in numbers)
        if i in sure:
            out.append((i, True))
        elif i in numbers:
            if k > 1 and text.isdigit() and (k + 1 == len(filled) or (i - filled[k - 1] > 1)):
                out.append((i, True))
        elif k < 2 or _HEADING.match(lines[i]) or re.match(r"\d+\. [A-ZÀ-Ý]", text):
            out.append((i, False))
        elif header(text) or text.isupper() and text.lower().startswith(title):
            out.append((i, True))
        elif len(text) > 45 and not re.search(r"- pag\.?\s*\d+$", text) and re.search(r"[a-zà-ù]{3} [a-zà-ù]{2}", text) or text[-1] in ".;":
            out.append((i, False))
        elif text.isupper() and not beside and len(text) < 45 and i and not lines[i - 1].strip():
            out.append((i, False))
    return out


def train_lines(texts: list[str]) -> Boosted:
    x, y = [], []
    for t in texts:
        lines = t.split("\n")
        features = line_features(lines)
        for i, furniture in seed_lines(lines):
            x.append(features[i])
            y.append(furniture)
    return Boosted(rounds=50, depth=5).fit(np.array(x), np.array(y)) if x and any(y) and not all(y) else Boosted(rounds=0).fit(np.zeros((1, 25)), np.zeros(1))


def furniture_lines(texts: list[list[str]], model: Boosted) -> list[set[int]]:
    """The furniture of each of several texts, whose lines are classified together."""
    features = [line_features(lines) for lines in texts]
    at = [(k, i) for k, fs in enumerate(features) for i, f in enumerate(fs) if f is not None]
    out: list[set[int]] = [set() for _ in texts]
    if at:
        for (k, i), p in zip(at, model.predict(np.array([features[k][i] for k, i in at]))):
            if p >= 0.5:
                out[k].add(i)
    return out


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.strip().lower()) - (1 << 63)


BLANK = line_hash("")


def core(word: str) -> str:
    """A word without an elided article: what follows the last apostrophe."""
    return re.split(r"['’]", word)[-1]


def scan_text(lines: list[str], furniture: set[int], lang: Language, keeps_hyphen, suspect_share: float, single: Language | None = None) -> list[tuple[int, str, str, str, str, str, int, int]]:
    """(line from 1, kind, word as right as it is known here, word as read, word before, word after, start in line, end) of
    furniture, splits and suspects. A word is suspect, or a gap one, by `lang` or by `single`, the counts of every line once."""
    langs = [lang, single] if single else [lang]
    frequent = frozenset.intersection(*(l.frequent for l in langs))
    out = [(i + 1, "furniture", "", lines[i].strip(), "", "", 0, len(lines[i])) for i in sorted(furniture)]
    prose = [i for i in range(len(lines)) if i not in furniture and lines[i].strip()]
    skip_head: dict[int, int] = {}
    cuts = []
    for k, i in enumerate(prose):
        start = skip_head.get(i, 0)
        m = _CUT.search(lines[i]) if lines[i].rstrip()[-1] in "-¬­‐" else None
        if m and k + 1 < len(prose) and m.start() >= start:
            j = prose[k + 1]
            head = _HEAD.match(lines[j])
            if head and not _HEADING.match(lines[j]) and (head[1][0].islower() or m[1].isupper() or head[1][0].isdigit() and any(c.isalpha() for c in head[1])):
                mark = lines[i].rstrip()[-1]
                cuts.append((i, j, m, head, mark))
                skip_head[j] = head.end()
    by_line = {c[0]: c for c in cuts}
    # the words of each line, the word cut at its end joined
    own: list[list[str]] = []
    for i in prose:
        cut = by_line.get(i)
        ws = _WORD.findall(lines[i][skip_head.get(i, 0) : cut[2].start() if cut else len(lines[i])].lower())
        if cut:
            left, right = core(cut[2][1]), cut[3][1]
            ws.append((f"{left}-{right}" if cut[4] == "-" and keeps_hyphen(left, right) else left + right).lower())
        own.append(ws)
    for k, i in enumerate(prose):
        ws, cut = own[k], by_line.get(i)
        if not cut and all(w in frequent or w.isdigit() for w in ws):
            continue
        last = next((o[-1] for o in reversed(own[max(0, k - 3) : k]) if o), "")
        following = next((o[0] for o in own[k + 1 : k + 4] if o), "")
        at = [(m.start(), m.end()) for m in _WORD.finditer(lines[i], skip_head.get(i, 0), cut[2].start() if cut else len(lines[i]))]
        for n, word in enumerate(ws):
            before, after = ws[n - 1] if n else last, ws[n + 1] if n + 1 < len(ws) else following
            if n == len(at):
                out.append((i + 1, "split", word, word, before, after, cut[2].start(), len(lines[i])))
                continue
            plain, (a, z) = word.isalpha(), at[n]
            if not plain and not any(c.isalpha() for c in word):
                continue
            if any(l.words.get(word, 0.0) < suspect_share for l in langs) or not plain and any(c.isdigit() for c in word):
                out.append((i + 1, "suspect", word, word, before, after, a, z))
            if plain and n + 1 < len(at) and at[n + 1][0] == z + 1 and lines[i][z] == " " and not (word in frequent and after in frequent):
                whole = word + after
                gap = any(l.words.get(whole, 0.0) > min(l.words.get(word, 0.0), l.words.get(after, 0.0)) for l in langs)
                if gap and after.isalpha() and len(whole) > 4 and lines[i][z + 1].islower() == lines[i][z - 1].islower():
                    out.append((i + 1, "gap", whole, f"{word} {after}", before, ws[n + 2] if n + 2 < len(ws) else following, a, at[n + 1][1]))
    return out


FOUND = "table_name string, job_id long, line_no int, kind string, word string, seen string, before string, after string, a int, z int"


def find_noise(texts: DataFrame, known_share: float = 0.003, suspect_share: float = 0.01, fit_texts: int = 1500) -> DataFrame:
    """texts (table_name, job_id, markdown) -> table_name, job_id, line_no, kind (split, misread, furniture), word (the whole right
    word in lower case, empty for furniture), seen (as it stands there), a, z (where in its line).

    Null and empty texts give no row; repeated rows count once. The models are fitted on the vocabulary and on at most
    about `fit_texts` texts chosen by a hash of the id; counts are over all texts, each different line in the text of
    least hash that has it.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col("table_name").cast("string").alias("table_name"), F.col("job_id").cast("long").alias("job_id"), F.col("markdown").cast("string").alias("markdown"))
    texts = texts.where("job_id is not null and markdown is not null and markdown <> ''").dropDuplicates(["table_name", "job_id"])
    texts = materialize(texts, "noise-texts")
    n = texts.count()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [list({line_hash(l) for l in t.split("\n")} - {BLANK}) for t in batch["markdown"]]
            yield pd.DataFrame({"line": np.array([h for hs in lines for h in hs], dtype=np.int64), "text": np.repeat(batch["text"].to_numpy(), [len(hs) for hs in lines])})

    text_hash = F.xxhash64("table_name", "job_id").alias("text")
    owners = texts.select(text_hash, "markdown").mapInPandas(hashed, "line long, text long").groupBy("line").agg(F.min("text").alias("text"))
    owners = materialize(owners.groupBy("text").agg(F.collect_list("line").alias("own_lines")), "noise-lines")
    n_own = owners.count()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, single = Counter(), Counter()
        for batch in batches:
            for t, own_lines in zip(batch["markdown"], batch["own_lines"]):
                own, once, first = set(), set(), set(own_lines if own_lines is not None else ())
                for line in t.split("\n"):
                    got = _WORD.findall(line.lower())
                    if got and line.rstrip()[-1:] in "-¬­‐":
                        got.pop()
                    got = [*(w for w in got if not w.isdigit()), *map(" ".join, zip(got, got[1:]))]
                    own.update(got)
                    if line_hash(line) in first:
                        once.update(got)
                words.update(own)
                single.update(once)
        yield pd.DataFrame([(w, k, single[w]) for w, k in words.items()], columns=["word", "n", "own"])

    counted = texts.select(text_hash, "markdown").join(owners, "text", "left").select("markdown", "own_lines").mapInPandas(count, "word string, n long, own long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    counted = materialize(counted, "noise-counts")
    # at most the mean number of different words and pairs of a text / known_share
    def language(count: str, of: int) -> Language:
        often = counted.where(F.col(count) >= max(3, known_share * of)).select("word", F.col(count).alias("n")).toPandas()
        return Language(
            {r.word: r.n / of for r in often.itertuples() if " " not in r.word},
            {tuple(r.word.split(" ")): r.n / of for r in often.itertuples() if " " in r.word},
            max(0.05, suspect_share),
        )

    lang, single = language("n", n), language("own", n_own)
    fit_rows = texts.where(F.pmod(F.xxhash64("table_name", "job_id"), F.lit(max(n, 1))) < fit_texts).limit(2 * fit_texts).select("markdown").toPandas()
    lines_model, joins, rankers = train_lines(list(fit_rows["markdown"])), train_joins(lang), (train_ranker(lang), train_ranker(single))
    shared = spark.sparkContext.broadcast((lang, single, lines_model, joins, rankers))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang, single, lines_model, joins, _ = shared.value
        known: dict[tuple[str, str], bool] = {}

        def keeps_hyphen(left: str, right: str) -> bool:
            if (left, right) not in known:
                known[left, right] = bool(joins.predict(np.array([join_features(lang, left, right)]))[0] >= 0.5)
            return known[left, right]

        for batch in batches:
            texts = [t.split("\n") for t in batch["markdown"]]
            gone = [g for i in range(0, len(texts), 200) for g in furniture_lines(texts[i : i + 200], lines_model)]
            rows = [(name, job, *r) for name, job, lines, g in zip(batch["table_name"], batch["job_id"], texts, gone) for r in scan_text(lines, g, lang, keeps_hyphen, suspect_share, single)]
            yield pd.DataFrame(rows, columns=["table_name", "job_id", "line_no", "kind", "word", "seen", "before", "after", "a", "z"])

    found = materialize(texts.mapInPandas(look, FOUND), "noise-found")
    # words that may be wrong: suspects, gapped words, and split words that are not known as they are joined
    listed = sorted(w for w in {*lang.words, *single.words} if len(w) > 1 and not any(c.isdigit() for c in w))
    seen_in = Counter(g for w in listed for g in set(grams(w)))
    rank = {g: k for k, (g, _) in enumerate(sorted(seen_in.items(), key=lambda x: (x[1], x[0])))}
    doubtful = found.where("kind in ('suspect', 'split', 'gap') and length(word) > 1").select("word").distinct()

    def posted(name: str):
        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own = [prefix(w, rank) for w in batch[name]]
                yield pd.DataFrame({name: batch[name].repeat([len(o) for o in own]).to_numpy(), "gram": [g for o in own for g in o]})

        return f

    # an inverted join on the rarest q-grams of both sides, then the count of all that are common
    vocabulary = spark.createDataFrame(pd.DataFrame(listed, columns=["candidate"]), "candidate string")
    q = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(F.concat(F.lit("^"), c, F.lit("$")), i, 2)))
    met = doubtful.mapInPandas(posted("word"), "word string, gram string").join(vocabulary.mapInPandas(posted("candidate"), "candidate string, gram string"), "gram")
    longest = F.greatest(F.length("word"), F.length("candidate"))
    near = met.where(F.abs(F.length("word") - F.length("candidate")) <= 2).select("word", "candidate").distinct()
    near = near.where(F.size(F.array_intersect(q(F.col("word")), q(F.col("candidate")))) >= longest + 1 - F.when(longest > 5, 4).otherwise(3))
    near = near.groupBy("word").agg(F.collect_list("candidate").alias("candidates"))  # words within two confusions of one word
    shares = counted.where("not contains(word, ' ')").select("word", (F.col("n") / n).alias("share"), (F.col("own") / max(n_own, 1)).alias("single_share"))
    open_ = found.where("kind in ('suspect', 'split', 'gap')").join(near, "word", "left").join(shares, "word", "left")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang, single, _, _, rankers = shared.value
        for batch in batches:
            best: dict[int, tuple[float, str]] = {}
            for words, ranker, shares in ((lang, rankers[0], batch["share"]), (single, rankers[1], batch["single_share"])):
                x, at = [], []
                for k, (r, own) in enumerate(zip(batch.itertuples(), shares)):
                    own = 0.0 if own is None or own != own else own
                    if r.kind == "gap":
                        # the rarer part vouches for a gapped word, or against it
                        own = min(words.words.get(part, 0.0) for part in r.seen.split(" "))
                    elif r.kind == "split" and r.word in words.words:
                        continue
                    for c in r.candidates if r.candidates is not None else ():
                        if c == r.word and r.kind != "gap" or r.kind == "gap" and c != r.word:
                            continue
                        if words.words.get(c, 0.0) >= max((20 if r.kind != "gap" else 1) * (own if not any(ch.isdigit() for ch in r.word) else 0.0), 1e-12):
                            x.append(words.features(r.seen if r.kind == "gap" else r.word, max(own, 1e-5), c, r.before, r.after))
                            at.append((k, c))
                for (k, c), v in zip(at, ranker.predict(np.array(x)) if x else []):
                    best[k] = max(best.get(k, (0.0, "")), (float(v), c))
            rows = []
            for k, r in enumerate(batch.itertuples()):
                v, c = best.get(k, (0.0, ""))
                if v >= 0.5:
                    rows.append((r.table_name, r.job_id, r.line_no, "misread" if r.kind == "suspect" else r.kind, c, r.seen, r.before, r.after, r.a, r.z))
                elif r.kind == "split":
                    rows.append((r.table_name, r.job_id, r.line_no, "split", r.word, r.seen, r.before, r.after, r.a, r.z))
            yield pd.DataFrame(rows, columns=["table_name", "job_id", "line_no", "kind", "word", "seen", "before", "after", "a", "z"])

    ranked = materialize(open_.mapInPandas(choose, FOUND), "noise-ranked")
    gaps = ranked.where("kind = 'gap'").withColumn("kind", F.lit("misread"))
    furniture = found.where("kind = 'furniture'")
    # a part of a gapped word is no case of its own
    parts = gaps.select("table_name", "job_id", "line_no", F.col("a").alias("from"), F.col("z").alias("to"))
    alone = ranked.where("kind = 'misread'").join(parts, ["table_name", "job_id", "line_no"], "left_anti").unionByName(
        ranked.where("kind = 'misread'").join(parts, ["table_name", "job_id", "line_no"]).groupBy(*ranked.columns).agg(F.max(((F.col("a") >= F.col("from")) & (F.col("z") <= F.col("to"))).cast("int")).alias("inside")).where("inside = 0").drop("inside")
    )
    every = alone.unionByName(gaps).unionByName(furniture).unionByName(ranked.where("kind = 'split'"))
    return every.select("table_name", "job_id", "line_no", "kind", "word", "seen", "a", "z")


def repair_text(text: str | None, cases: list[tuple[int, str, str, int, int]]) -> str | None:
    """The text with its cases (line, kind, word, start, end) mended: furniture gone, cut words joined, misread
    words replaced in their own capitals, and the lines of a paragraph run together."""
    if text is None:
        return None
    lines = text.split("\n")
    gone = {n - 1 for n, kind, *_ in cases if kind == "furniture"}
    splits = {n - 1: (word, a) for n, kind, word, a, _ in cases if kind == "split"}

    def like(word: str, seen: str) -> str:
        letters = [c for c in seen if c.isalpha()]
        return word.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else word[:1].upper() + word[1:] if seen[:1].isupper() else word

    for n, kind, word, a, z in sorted(cases, key=lambda c: (c[0], -c[3])):
        if kind == "misread" and n - 1 not in gone and z <= len(lines[n - 1]):
            lines[n - 1] = lines[n - 1][:a] + like(word, lines[n - 1][a:z]) + lines[n - 1][z:]
    out: list[str] = []
    head = False
    was_gap, after_furniture = True, False
    for i, line in enumerate(lines):
        if i in gone:
            after_furniture = True
            continue
        if not line.strip():
            was_gap = True
            continue
        if head:
            m = _HEAD.match(line)
            line = line[m.end() :] if m else line
        cut = splits.get(i)
        if cut:
            m = _CUT.search(line)
            if m:
                seen = m[1]
                lead = seen[: len(seen) - len(core(seen))]
                line = line[: m.start()] + lead + like(cut[0], core(seen))
        # a paragraph goes on over a page's furniture unless the sentence had ended
        goes_on = out and not _HEADING.match(line) and (head or not was_gap or after_furniture and out[-1][-1:] not in ".:;!?*" and line.strip()[:1].islower())
        if goes_on and not _HEADING.match(out[-1]):
            out[-1] += ("" if head else " ") + line.rstrip()
        else:
            out.append(line.strip())
        head, was_gap, after_furniture = bool(cut), False, False
    return "\n\n".join(out)


def repair(texts: DataFrame, found: DataFrame) -> DataFrame:
    """table_name, job_id, markdown with the found cases mended; one row for each text that isn't null. A text without
    cases has its paragraphs run together all the same."""
    cases = found.groupBy("table_name", "job_id").agg(F.collect_list(F.struct("line_no", "kind", "word", "a", "z")).alias("cases"))
    joined = texts.where("markdown is not null").dropDuplicates(["table_name", "job_id"]).join(cases, ["table_name", "job_id"], "left")

    @F.pandas_udf("string")
    def mend(text: pd.Series, cases: pd.Series) -> pd.Series:
        return pd.Series([repair_text(t, [(c["line_no"], c["kind"], c["word"], c["a"], c["z"]) for c in (cs if cs is not None else ())]) for t, cs in zip(text, cases)], dtype=object)

    return joined.select("table_name", "job_id", mend("markdown", "cases").alias("markdown"))
