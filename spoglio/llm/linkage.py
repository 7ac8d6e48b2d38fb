"""Which file an index entry describes: probabilistic record linkage.

Entries and files share no key, but each yields the same partial attributes: the act named (mapped to the
canonical list), a date, a protocol number, a person, and the reference or path itself, folded to
letters and digits. Candidate pairs come from several blocking passes inside the folder or unit that the index
lists, wide enough that most pairs are none. Every pair gets a level of agreement for each attribute; the probabilities of the levels
among matches and non-matches are estimated by expectation maximisation over the counts of the level patterns, and the
posterior of a pattern is the confidence of its pairs, which accepts or rejects them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoglio.llm.canonical import STOP, Trie, edits, fold, within
from spoglio.session import materialize

_MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()
_DATE = re.compile(
    r"(?<!\d)(?:(?P<y>(?:19|20)\d\d)[-./_ ](?P<m>\d{1,2})[-./_ ](?P<d>\d{1,2})|(?P<d2>\d{1,2})[-./_ ](?P<m2>\d{1,2})[-./_ ](?P<y2>(?:19|20)\d\d|\d\d)"
    rf"|(?P<c>(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))|(?P<d3>\d{{1,2}})[ _](?P<n>{'|'.join(_MONTHS)})[ _](?P<y3>(?:19|20)\d\d))(?!\d)",
    re.IGNORECASE,
)
_PROT = re.compile(r"(?:\bn\.?\s*)?\bprot(?:ocollo)?\.?\s*(?:n\.?\s*)?(\d{1,6})\b|\bn\.?\s?(\d{4,6})\b|\((\d{3,6})\)|(?<![\d/])(\d{4,6})(?![\d/])", re.IGNORECASE)
_PERSON = re.compile(r"(?:\bc/|\ba carico di|\bcontro|\bnei confronti di)\s*([A-Za-zÀ-ÿ'0-9]+)", re.IGNORECASE)
# Words that stand for any document, and the labels of a unit's own document.
GENERIC = frozenset("documento atto allegato file scan scansione vedi doc documenti img immagine copia conforme e allegati in data del n prot unita".split())
_MAIN = re.compile(r"\s*(?:documento principale|atto principale(?: del fascicolo)?|unit[aà]\s+\d+)\s*", re.IGNORECASE)
_COPY = re.compile(r"^(?:copia(?: di)?[ _-]+|\(\d+\)\s*)|[ _-]+(?:copia|copy|\(\d+\))$", re.IGNORECASE)


def squash(text: str | None) -> str | None:
    """A path or name folded to letters and digits, percent-decoded; null if nothing is left."""
    if text is None:
        return None
    return re.sub(r"[^a-z0-9]", "", fold(unquote(text))) or None


def dates(text: str) -> tuple[int | None, str]:
    """(first date as yyyymmdd, the text without dates)"""
    first = None
    for m in _DATE.finditer(text):
        if m["c"]:
            got = int(m["c"])
        else:
            y = int(m["y"] or m["y2"] or m["y3"])
            month = int(m["m"] or m["m2"] or _MONTHS.index(m["n"].lower()) + 1)
            got = (y + (2000 if y < 50 else 1900) * (y < 100)) * 10_000 + month * 100 + int(m["d"] or m["d2"] or m["d3"])
        if 1 <= got % 10_000 // 100 <= 12 and 1 <= got % 100 <= 31 and first is None:
            first = got
    return first, _DATE.sub(" ", text)


def protocol(text: str) -> tuple[int | None, str]:
    m = _PROT.search(text)
    found = int(next(g for g in m.groups() if g)) if m else None
    return found, _PROT.sub(" ", text)


class Acts:
    """Title and person in a label or file name."""

    def __init__(self, entries: list[tuple[int, str]]) -> None:
        self.trie = Trie(entries)
        self.flat: dict[str, int] = {}
        for n, text in entries:
            tokens = re.findall(r"[a-z0-9]+", fold(text))
            self.flat["".join(tokens)] = n
            self.flat["".join(t for t in tokens if t not in STOP)] = n
        self.cache: dict[str, tuple[int, float]] = {}
        self.words = {w for _, text in entries for w in re.findall(r"[a-z0-9]+", fold(text)) if w not in STOP}
        self.first: dict[str, list[int]] = {}
        for n, text in entries:
            self.first.setdefault(fold(text).split()[0], []).append(n)
        self.like: dict[str, bool] = {}
        self.known: dict[str, tuple[int, str | None]] = {}

    def word_of_title(self, token: str) -> bool:
        """Whether a word may belong to a title: one of its words, cut short or misspelt."""
        t = re.sub(r"[^a-z0-9]", "", fold(token))
        got = self.like.get(t)
        if got is None:
            got = t in STOP or len(t) < 3 or any(w.startswith(t) or within(t, w, 1 + (len(t) >= 8)) or len(t) >= 4 and within(t, w[: len(t)], 1) for w in self.words)
            if len(self.like) > 200_000:
                self.like.clear()
            self.like[t] = got
        return got

    def title(self, tokens: list[str]) -> tuple[int, float]:
        """(entry or 0, distance) of a list of words; words may be run together."""
        text = fold(" ".join(t + "." * (len(t) == 1) for t in tokens))
        got = self.cache.get(text)
        if got is None:
            n, d, _ = self.trie.find(text) if text else (0, None, 0)
            if not n:
                flat = re.sub(r"[^a-z0-9]", "", fold(text))
                near = [(edits(flat, f), m) for f, m in self.flat.items() if within(flat, f, 2)] if len(flat) >= 8 else []
                d, n = min(near, default=(9, 0))
                n = n if d <= 2 else 0
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[text] = (n, float(d) if n else 9.0)
        return got

    def read(self, text: str) -> tuple[int, str | None]:
        """(title or 0, person in lower case or None) of text without dates and numbers; equal texts are read once."""
        text = re.sub(r"\s+", " ", text).strip()
        got = self.known.get(text)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[text] = self._read(text)
        return got

    def _read(self, text: str) -> tuple[int, str | None]:
        m = _PERSON.search(text)
        person = m[1] if m else None
        if m:
            text = text[: m.start()] + " - " + text[m.end() :]
        best: tuple[float, int, str | None] = (9.0, 0, None)
        parts = [p.strip(" -_,.;") for p in re.split(r"\s-\s|\s-$|^-\s", text)]
        parts = [p for p in parts if p]
        tries: list[tuple[str, str | None]] = [(text, None)]
        if len(parts) > 1:
            tries += [(" - ".join(parts[:k] + parts[k + 1 :]), p) for k, p in enumerate(parts)]
        end = re.search(r"\sdi\s+([A-ZÀ-Þ][a-zà-ÿ0-9]{3,})\s*$", text)
        if end and not self.word_of_title(end[1]):
            tries = [(text[: end.start()], end[1])]
        for body, aside in tries:
            if aside is not None:
                w = [t for t in re.findall(r"[A-Za-zÀ-ÿ0-9']+", aside) if t.lower() not in STOP]
                if len(w) != 1 and w:
                    continue
                aside = w[0] if w else None
            front = re.search(r"\(([^()]*)\)\W*$", body)
            if front:
                body = f"{front[1]} {body[: front.start()]}"
            body = re.sub(r"([a-zà-ÿ])([A-ZÀ-Þ][a-zà-ÿ])", r"\1 \2", body) if not re.search(r"[ _-]", body.strip(" _-.")) or re.search(r"[a-z][A-Z][a-z]+[A-Z]?", body) else body
            body = re.sub(r"\.\s?(?:le|va|vo|ni|ne|sta|ta|to)\b", ". ", body)
            tokens = re.findall(r"[A-Za-zÀ-ÿ0-9']+\.?", body.replace("_", " ").replace("-", " "))
            tokens = [t for t in tokens if not re.fullmatch(r"\d+|(?i:prot|n|in data|data|copia|conforme|allegati|pdf|tif|unit[aà])\.?", t)]
            while tokens and tokens[-1].lower().rstrip(".") in STOP:
                tokens.pop()
            cuts = [(tokens, None), (tokens[:-1], tokens[-1:]), (tokens[1:], tokens[:1])]
            if not aside and not person and len(tokens) > 1:
                if not self.word_of_title(tokens[-1]):
                    cuts = cuts[1:2]
                elif not self.word_of_title(tokens[0]):
                    cuts = cuts[2:]
            for cut, who in cuts:
                if best[0] <= 0.35 and who is not None:
                    continue
                if who is not None and (aside or person or not who or len(who[0].rstrip(".")) < 4 or who[0].endswith(".") and len(who[0]) < 7):
                    continue
                n, d = self.title([t.rstrip(".") + "." * t.endswith(".") for t in cut])
                who_is = who[0].rstrip(".") if who else aside
                d += 0.4 if who else 0.0
                if n and d < best[0]:
                    best = (d, n, who_is)
            if not best[1] and aside is None and len(tokens) == 1 and not person and tokens[0].lower().rstrip(".") not in GENERIC and not self.word_of_title(tokens[0]):
                best = (8.9, 0, tokens[0].rstrip("."))
            if not best[1] and aside and best[2] is None and not self.word_of_title(aside):
                best = (8.9, 0, aside)
        who = person or best[2]
        who = fold(who).replace("0", "o").replace("1", "l") if who else None
        if not best[1]:  # a title cut down to its first word
            w = re.findall(r"[a-z]+", fold(text))
            starts = {n for x in w for f, ns in self.first.items() if len(x) >= 4 and f.startswith(x) for n in ns} if len([x for x in w if x not in STOP and x not in GENERIC]) <= 2 else set()
            best = (9.0, min(starts) if len(starts) == 1 else 0, best[2])
        return best[1], who if who and who not in GENERIC and who not in STOP and len(who) > 2 else None

    def attributes(self, text: str | None) -> tuple[int, int | None, int | None, str | None]:
        """(title, date, protocol, person) of a label or of a file name without its suffix."""
        if not text:
            return 0, None, None, None
        day, rest = dates(text)
        rest = re.sub(r"^\s*(?:\(\d+\)\s*|(?i:copia)(?:\s+di)?[ _-]+)?(?:\d{1,3}\s*[-_. ]+)?", " ", rest)
        number, rest = protocol(rest.replace("_", " "))
        rest = re.sub(r"\b(?:in data|del|prot\.?|n\. prot\.?|e allegati|\(copia conforme\)|- copia|vedi file)(?=\W|$)", " ", rest, flags=re.IGNORECASE) if not re.search(r"(?i)\b(?:certificato|certif\.?) del|comunicaz\w* del", rest) else re.sub(r"(?i)\b(?:in data|prot\.?|e allegati|\(copia conforme\)|- copia)", " ", rest)
        return (lambda t: (t[0], day, number, t[1]))(self.read(rest))


def stem(path: str) -> str:
    name = re.split(r"[/\\]", unquote(path))[-1]
    return re.sub(r"\.[A-Za-z]{3,4}$", "", name)


#: Attributes of a pair and their levels, from worst to best; level MISSING, where one side lacks the attribute, is no evidence.
LEVELS = {"title": 3, "day": 3, "number": 3, "person": 4, "path": 4, "main": 3}
MISSING = 1
_PAIR = list(LEVELS)


def fit(patterns: pd.DataFrame, chance: pd.DataFrame, rounds: int = 300, prior: float = 0.5, slip: float = 0.002, believed: float = 5.0, odd: float = 0.05, known: float = 0.1) -> tuple[np.ndarray, dict]:
    """Log odds of a match for each pattern of levels, under independence given the class.

    patterns: the columns of LEVELS and n, of the candidate pairs; chance: the same of pairs drawn at random, practically all of them
    non-matches, from which the probabilities among non-matches start and which stay known non-matches, with the weight of `known` of the candidates. The probabilities among matches and
    among non-matches and the share of matches are found by expectation maximisation, from the assumption that higher levels are likelier
    among matches."""
    if not len(patterns):
        return np.zeros(0), {}
    n = patterns["n"].to_numpy(dtype=float)
    at = {a: patterns[a].to_numpy(dtype=int) for a in _PAIR}

    def shares(counts: np.ndarray, belief: np.ndarray) -> np.ndarray:
        """Of the levels that say something, with `believed` pairs spread as `belief`; none falls below `slip`, the chance that an
        attribute was misread."""
        says = np.arange(len(counts)) != MISSING
        counts = np.where(says, counts + believed * belief / belief[says].sum(), 0.0)
        return np.where(says, np.maximum(counts / counts.sum(), slip), 1.0)

    def held(a: str, found: np.ndarray, free: str, most: slice) -> np.ndarray:
        """The share of the levels `most` bounded by `odd`: of disagreement in what describes a match, but for references, which go
        stale, and of agreement in what describes none, but for the act, which candidates share by their keys."""
        bound = np.zeros(len(found), dtype=bool)
        bound[most] = True
        bound[MISSING] = False
        rest, says = found[~bound].sum() - 1.0, np.arange(len(found)) != MISSING
        if a == free or found[bound].sum() <= odd or rest <= 0:
            return found
        return np.where(says, np.where(bound, found * odd / found[bound].sum(), found * (1 - odd) / rest), 1.0)

    rising = {a: np.linspace(1, 4 * k, k) ** 2 for a, k in LEVELS.items()}
    none = {a: np.array([chance.loc[chance[a] == v, "n"].sum() for v in range(k)], dtype=float) * known * n.sum() / max(chance["n"].sum(), 1) for a, k in LEVELS.items()}
    m, u, p = {a: shares(0 * rising[a], rising[a]) for a in LEVELS}, {a: shares(none[a], rising[a][::-1]) for a in LEVELS}, prior
    for _ in range(rounds):
        odds = sum(np.log(m[a][at[a]] / u[a][at[a]]) for a in _PAIR) + np.log(p / (1 - p))
        g = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        new = float(np.clip((g * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
        m = {a: held(a, shares(np.array([(g * n)[at[a] == v].sum() for v in range(k)]), rising[a]), "path", slice(0, 1)) for a, k in LEVELS.items()}
        u = {a: held(a, shares(none[a] + [((1 - g) * n)[at[a] == v].sum() for v in range(k)], rising[a][::-1]), "title", slice(2, k)) for a, k in LEVELS.items()}
        if abs(new - p) < 1e-9:
            break
        p = new
    return odds, {"p": p, "m": m, "u": u}


def threshold(odds: np.ndarray, n: np.ndarray, most_wrong: float = 0.01) -> float:
    """The least posterior at which the pairs accepted are expected to be wrong in at most `most_wrong` of them, never below one half."""
    g = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    order = np.argsort(-g, kind="stable")
    wrong = np.cumsum(((1 - g) * n)[order]) / np.maximum(np.cumsum(n[order]), 1e-9)
    good = np.flatnonzero((wrong <= most_wrong) & (g[order] >= 0.5))
    return float(g[order][good[-1]]) if len(good) else 1.0


def _read_entries(acts: list[tuple[int, str]]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Acts(acts)
        for batch in batches:
            rows = []
            for e, case, index, label, ref, day in zip(batch["entry_id"], batch["casefile_id"], batch["index_path"], batch["label"], batch["referenced_path"], batch["document_date"]):
                unit = index.split("/")[0] if index and "/" in index else ""
                name = stem(ref) if ref else None
                a, b = reader.attributes(label), reader.attributes(name)
                days = {x for x in (a[1], b[1], dates(day or "")[0]) if x}
                main = bool(label and _MAIN.fullmatch(label))
                number = re.search(r"\d+", label) if main and "unit" in fold(label) else None
                rows.append((
                    e, case, unit, sorted({x for x in (a[0], b[0]) if x}), sorted(days), sorted({x for x in (a[2], b[2]) if x}), sorted({x for x in (a[3], b[3]) if x}),
                    squash(ref), squash(re.split(r"[/\\]", ref)[-1]) if ref else None, (unit or (number[0] if number else "")) if main else None,
                ))
            yield pd.DataFrame(rows, columns=["entry_id", "casefile_id", "unit", "titles", "days", "numbers", "persons", "ref_path", "ref_name", "main_of"])

    return read


def _read_files(acts: list[tuple[int, str]]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Acts(acts)
        for batch in batches:
            rows = []
            for d, case, path in zip(batch["case_doc_id"], batch["casefile_id"], batch["relative_path"]):
                parts = path.replace("\\", "/").split("/")
                unit, name = parts[0] if len(parts) > 1 else "", parts[-1]
                main = len(parts) == 2 and name.lower() == f"{unit.lower()}.pdf"
                a = (0, None, None, None) if main else reader.attributes(stem(name))
                inner = "/".join(parts[1:]) if len(parts) > 1 else name
                rows.append((d, case, unit, *a, squash(path), squash(inner), squash(name), main, bool(_COPY.search(stem(name)))))
            out = pd.DataFrame(rows, columns=["case_doc_id", "casefile_id", "file_unit", "title", "day", "number", "person", "path", "inner", "name", "is_main", "is_copy"])
            yield out.astype({"day": "Int64", "number": "Int64"})

    return read


def link_entries(entries: DataFrame, files: DataFrame, acts: DataFrame) -> DataFrame:
    """entries (entry_id, casefile_id, index_path, label, referenced_path, document_date), files (case_doc_id, casefile_id,
    relative_path) and acts (canon_id, canonical) -> entry_id, case_doc_id, confidence, levels: the file each entry
    describes, at most one.

    A pair is accepted by its posterior, at a threshold fitted so that at most a hundredth of the accepted pairs is expected to be
    wrong; of an entry's accepted files the one of the greatest log odds is taken, an original before its copy, the least id at last. An exact
    check follows: the reference is the file's path or name but for separators, case and encoding, or the entry stands for its unit's own
    document, or no two acts contradict each other and the date, the protocol number or the person agrees. Entries without
    such a file have no row. Nulls in any column agree with nothing; rows delivered twice count once; empty tables give no rows. Technical
    markers and index files are nobody's file. Other columns are ignored.
    """
    spark = entries.sparkSession
    listed = [(int(r.canon_id), r.canonical) for r in acts.select("canon_id", "canonical").dropna().orderBy("canon_id").collect()]
    # a set number of partitions: reading a name costs far more than the few bytes by which they would be merged
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = lambda *cs: [F.col(c).cast("string").alias(c) for c in cs]
    e = entries.select(F.col("entry_id").cast("long").alias("entry_id"), *text("casefile_id", "index_path", "label", "referenced_path", "document_date")).where("entry_id is not null and casefile_id is not null").repartition(wide, "entry_id").dropDuplicates(["entry_id"])
    e = e.mapInPandas(_read_entries(listed), "entry_id long, casefile_id string, unit string, titles array<int>, days array<long>, numbers array<long>, persons array<string>, ref_path string, ref_name string, main_of string")
    e = materialize(e, "link-entries")
    d = files.select(F.col("case_doc_id").cast("long").alias("case_doc_id"), *text("casefile_id", "relative_path")).where("case_doc_id is not null and casefile_id is not null and relative_path is not null")
    d = d.where(~F.col("relative_path").rlike(r"(?i)(^|/)(complete|listaallegati\.html?)$")).repartition(wide, "case_doc_id").dropDuplicates(["case_doc_id"])
    d = d.mapInPandas(_read_files(listed), "case_doc_id long, casefile_id string, file_unit string, title int, day long, number long, person string, path string, inner string, name string, is_main boolean, is_copy boolean")
    d = materialize(d, "link-files")

    pairs = _candidates(e, d)
    agree = lambda have, want: F.when(F.col(want).isNull() | (F.size(have) == 0), 1).when(F.array_contains(F.col(have), F.col(want)), 2).otherwise(0)
    gap = F.array_min(F.transform("persons", lambda p: F.levenshtein(p, F.col("person"))))
    levels = [
        "entry_id", "case_doc_id", "is_copy",
        F.when((F.col("title") == 0) | (F.size("titles") == 0), 1).when(F.array_contains(F.col("titles"), F.col("title")), 2).otherwise(0).alias("title"),
        agree("days", "day").alias("day"), agree("numbers", "number").alias("number"),
        F.when(F.col("person").isNull() | (F.size("persons") == 0), 1).when(gap == 0, 3).when(gap <= 2, 2).otherwise(0).alias("person"),
        F.when(F.col("ref_path").isNull(), 1).when((F.col("ref_path") == F.col("path")) | (F.col("ref_path") == F.col("inner")), 3).when(F.col("ref_name") == F.col("name"), 2).otherwise(0).alias("path"),
        F.when(F.col("main_of").isNull(), 1).when(F.col("is_main") & (F.col("main_of") == F.col("file_unit")), 2).otherwise(0).alias("main"),
    ]
    compare = lambda p: p.join(e.drop("casefile_id"), "entry_id").join(d.drop("casefile_id"), "case_doc_id").select(levels)
    both = materialize(compare(pairs), "link-pairs")
    # about one random file for each entry, from anywhere; of a small input some more
    n, most = e.count(), d.count()
    n = max(1, n * most // max(n, 20_000))
    toss = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n))
    random = e.select("entry_id", toss("entry_id", 1).alias("b")).join(d.select("case_doc_id", toss("case_doc_id", 2).alias("b")), "b").select("entry_id", "case_doc_id")
    # at most the product of LEVELS
    count = lambda p: p.groupBy(*_PAIR).agg(F.count("*").alias("n")).toPandas().sort_values(_PAIR).reset_index(drop=True)
    patterns = count(both)
    odds, _ = fit(patterns, count(compare(random)))
    least = threshold(odds, patterns["n"].to_numpy(dtype=float))
    fitted = ", ".join(f"{a} int" for a in _PAIR) + ", odds double, confidence double"
    scored = patterns[_PAIR].assign(odds=odds, confidence=1 / (1 + np.exp(-np.clip(odds, -500, 500))))
    scored = spark.createDataFrame(scored if len(scored) else [], fitted)
    accepted = both.join(F.broadcast(scored), _PAIR).where(F.col("confidence") >= least)
    best = Window.partitionBy("entry_id").orderBy(F.desc("odds"), F.asc("is_copy"), F.asc("case_doc_id"))
    holds = (F.col("path") >= 2) | (F.col("main") == 2) | ((F.col("title") >= 1) & ((F.col("day") == 2) | (F.col("number") == 2) | (F.col("person") >= 2)))
    out = accepted.where(holds).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return out.select("entry_id", "case_doc_id", "confidence", F.concat_ws(" ", *[F.concat(F.lit(f"{a}="), F.col(a)) for a in _PAIR]).alias("levels"))


def _candidates(e: DataFrame, d: DataFrame, block: int = 256) -> DataFrame:
    """entry_id, case_doc_id of every pair that shares a key of one of the passes, inside the folder or unit that the index lists.

    Everywhere: the file's name; the unit's own document; the act (or none) with the date, with the number, and with the person by its first or last three
    letters (two of a name of six or fewer), or by three letters of its middle, so that a name with one edit anywhere, or two in a name of nine letters, is met. Within a
    unit also the act, the date, the number or the person alone, whose pairs a unit's size bounds. Keys are hashes; a collision is one more pair to compare.
    The pairs of a crowded key are made in squares of about `block` rows to the side, in different tasks."""
    none = F.array().cast("array<long>")
    one = lambda c, k: F.when(F.col(c).isNotNull(), F.array(k)).otherwise(none)

    def person(key, t, x, shifts, around):
        """Of a name's ends and middle; the lengths that its ends have in names `around` letters longer count as well."""
        ends = lambda n: F.when(F.length(x) + n <= 6, 2).otherwise(3)
        parts = [p for n in around for p in (key("S", t, F.substring(x, F.lit(1), ends(n))), key("E", t, F.substring(x, -ends(n), ends(n))))]
        return F.array(*parts, *[key("G", t, F.substring(x, F.greatest(F.lit(1), F.floor(F.length(x) / 2).cast("int") + by), F.lit(3))) for by in shifts])

    def entry_keys(unit: str, alone: bool):
        key = lambda kind, *xs: F.xxhash64(F.lit(kind), "casefile_id", unit, *xs)
        titles = F.array_union(F.col("titles"), F.array(F.lit(0)))
        over = lambda xs, f: F.flatten(F.transform(titles, lambda t: F.flatten(F.transform(xs, lambda x: f(t, x)))))
        with_act = lambda kind: lambda t, x: F.array(key(kind, t, x))
        keys = [over(F.col("days"), with_act("D")), over(F.col("numbers"), with_act("R")), over(F.col("persons"), lambda t, x: person(key, t, x, (-1, 0, 1), (-1, 0, 1))), one("ref_name", key("N", "ref_name")), one("main_of", key("M", "main_of"))]
        if alone:
            keys += [F.transform("titles", lambda x: key("t", x)), F.transform("days", lambda x: key("d", x)), F.transform("numbers", lambda x: key("r", x)), F.transform("persons", lambda x: key("p", F.substring(x, 1, 3)))]
        return F.explode(F.array_distinct(F.concat(*keys))).alias("key")

    def file_keys(unit, alone: bool):
        key = lambda kind, *xs: F.xxhash64(F.lit(kind), "casefile_id", unit, *xs)
        keys = [one("day", key("D", "title", "day")), one("number", key("R", "title", "number")), F.when(F.col("person").isNotNull(), person(key, F.col("title"), F.col("person"), (0,), (0,))).otherwise(none), one("name", key("N", "name")), F.when(F.col("is_main"), F.array(key("M", "file_unit"))).otherwise(none)]
        if alone:
            keys += [F.when(F.col("title") > 0, F.array(key("t", "title"))).otherwise(none), one("day", key("d", "day")), one("number", key("r", "number")), one("person", key("p", F.substring("person", 1, 3)))]
        return F.explode(F.array_distinct(F.concat(*keys))).alias("key")

    # an index in a unit meets that unit's files, an index at the root those of the whole folder
    e_keys = e.where("unit <> ''").select("entry_id", entry_keys("unit", True)).unionByName(e.where("unit = ''").select("entry_id", entry_keys("unit", False)))
    d_keys = d.where("file_unit <> ''").select("case_doc_id", file_keys("file_unit", True)).unionByName(d.select("case_doc_id", file_keys(F.lit(""), False)))
    both = e_keys.select("key", F.lit(1).alias("n_e"), F.lit(0).alias("n_d")).unionByName(d_keys.select("key", F.lit(0).alias("n_e"), F.lit(1).alias("n_d")))
    squares = lambda c: F.ceil(F.sum(c) / block).cast("int")
    crowd = both.groupBy("key").agg(squares("n_e").alias("es"), squares("n_d").alias("ds")).where("es > 0 and ds > 0 and (es > 1 or ds > 1)")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    with_crowd = lambda rows: rows.join(crowd, "key", "left").na.fill(1, ["es", "ds"])
    left = with_crowd(e_keys).select("entry_id", "key", part("entry_id", "es").alias("i"), spread("ds").alias("j"))
    right = with_crowd(d_keys).select("case_doc_id", "key", part("case_doc_id", "ds").alias("j"), spread("es").alias("i"))
    return left.join(right, ["key", "i", "j"]).select("entry_id", "case_doc_id").distinct()
