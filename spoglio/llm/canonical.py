"""Mapping freely typed values to a list: a trie of the entries searched with a Levenshtein automaton.

Entries and values are folded to words without articles and prepositions. The trie holds each entry's words and has
alias paths: out of the inside of a word to its end, taken where the typed word ends early ("verb.", "perquis",
"trib.le"), and whole entries under fixed acronyms ("GdP"). The automaton walks the trie; its state at a node
is the set of places in the typed value that are within the edits (insertions, deletions, substitutions, swapped neighbours) a value of that length may differ by,
and a branch is left as soon as the state is empty. A value whose parts stand in the other order ("Montescuro -
Tribunale", "archiviazione (decreto)") is searched in both orders. All entries within the distance are found;
the nearest is the answer, none if the nearest two tie.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning in a title, acronyms, and what may follow a court or an act.
STOP = frozenset("di del dello della dei degli delle da in il lo la i gli le l che per a al d dell nell un una e sede".split())
ACRONYMS = {"gdp": "giudice pace", "tds": "tribunale sorveglianza", "tdm": "tribunale minorenni", "tpm": "tribunale minorenni", "tm": "tribunale minorenni", "cda": "corte appello"}
NOISE = re.compile(
    r"\s*(?:[,(\-]\s*)?\b(?:sez(?:ione|\.)?\b|(?:prima|seconda|terza|quarta)\s+sez|in\s+nome\b|in\s+composizione\b|emess[ao]\b|ha\s+pronunciato\b"
    r"|copia\b|e\s+allegat[oi]\b|con\s+allegat[oi]\b|n\.?\s*\d|nr\.?\s*\d|prot\.?\s*\d|(?:del|in data)\s+\d).*$"
)
_PREFIX = re.compile(r"^[\W_]*(?:\d{1,4}\s*[-.)]\s*)?(?:(?:il|la|lo|ufficio del)\s+)?")
ALIASES = {"minori": "minorenni"}
_OPTIONAL = frozenset({"ordinario", "ordinaria"})


def fold(value: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", value.replace("_", " ").replace("’", "'").lower()) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", flat).strip()


def words(text: str) -> list[tuple[str, bool]]:
    """(word, abbreviated) without stop words; "trib.le" is the abbreviated "trib", "g.d.p." is "gdp"."""
    text = re.sub(r"\b((?:[a-z]\.\s?){2,}[a-z]?)(?=[^a-z]|$)", lambda m: re.sub(r"[^a-z]", "", m[1]) + " " if re.sub(r"[^a-z]", "", m[1]) in ACRONYMS else m[1], text)
    out = []
    for token, dot in re.findall(r"([a-z0-9]+(?:\.[a-z]{2,3}(?![a-z.]))?)(\.?)", text):
        head, _, tail = token.partition(".")
        if token in STOP and not dot or head in _OPTIONAL:
            continue
        out.append((ALIASES.get(head, head), bool(dot or tail)))
    return out


def readings(value: str) -> list[tuple[str, float]]:
    """The forms in which a value is searched, each as words joined by spaces with "." after an abbreviated one, and the edits
    that the form itself takes: short words that may be a misspelt article or preposition are also left out."""
    text = NOISE.sub("", _PREFIX.sub("", fold(value)))
    orders = [text]
    m = re.fullmatch(r"(.*?)\s*\(([^()]*)\)\W*", text)
    if m:
        orders.append(f"{m[2]} {m[1]}")
    m = re.fullmatch(r"(.*?)\s+-\s+(.*)", text)
    if m:
        orders.append(f"{m[2]} {m[1]}")
    out = []
    for o in orders:
        got = words(o)
        if got and got[0][0] in ACRONYMS:
            got = [(w, False) for w in ACRONYMS[got[0][0]].split()] + got[1:]
        odd = {k for k, (w, dot) in enumerate(got) if not dot and len(w) <= 5 and any(len(s) > 1 and w != s and within(w, s, 1) for s in STOP)}
        for skip in (set(), odd) if odd else (set(),):
            kept = [x for k, x in enumerate(got) if k not in skip]
            if kept:
                out.append((" ".join(w + "." * dot for w, dot in kept), float(len(skip))))
    return list(dict.fromkeys(out))


def allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 10 else 2 if length < 18 else 3


def edits(a: str, b: str) -> int:
    """Edit distance with swapped neighbours as one edit."""
    rows = [list(range(len(b) + 1))]
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            least = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                least = min(least, rows[-2][j - 2] + 1)
            row.append(least)
        rows.append(row)
    return rows[-1][-1]


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most `limit`. An edit changes at most two members of the set of letters."""
    return abs(len(a) - len(b)) <= limit and len(set(a) ^ set(b)) <= 2 * limit and edits(a, b) <= limit


class _Node:
    __slots__ = ("next", "entry")

    def __init__(self) -> None:
        self.next: dict[str, _Node] = {}
        self.entry: list[int] = []


class Trie:
    """The entries of one list. entries: (id, text)."""

    def __init__(self, entries: list[tuple[int, str]]) -> None:
        self.root, self.exact = _Node(), {}
        self.last = {n: (words(fold(text)) or [("", False)])[-1][0] for n, text in entries}
        for n, text in entries:
            self.exact.setdefault(text, n)
            node = self.root
            for c in " ".join(w for w, _ in words(fold(text))) + " ":
                node = node.next.setdefault(c, _Node())
            node.entry.append(n)
        self.search = lru_cache(maxsize=50_000)(self._search)

    def _search(self, value: str) -> tuple[tuple[float, int], ...]:
        best: dict[int, float] = {}
        for reading, taken in readings(value):
            near: dict[int, float] = {}
            self._walk(reading, near)
            near = {n: d + taken for n, d in near.items() if d + taken <= allowed(len(reading)) + 0.5}
            last = reading.split()[-1].rstrip(".")
            for n, d in near.items():
                # three edits may be spread over a long value but not sit in one word of it
                if d <= 2.5 or not reading.endswith(".") and edits(last, self.last[n]) <= 2:
                    best[n] = min(best.get(n, d), d)
        return tuple(sorted((d, n) for n, d in best.items()))

    def _walk(self, reading: str, best: dict[int, float]) -> None:
        dots, chars = set(), []
        for c in reading + " ":
            if c == ".":
                dots.add(len(chars))
            else:
                chars.append(c)
        text, limit = "".join(chars), allowed(len(chars) - 1)
        n, far = len(text), limit + 1.0
        ends = {j for j in range(1, n) if text[j] == " "}

        # a state of the automaton: the places in the typed text that are within the limit, in order, with their edits
        def closed(cells: dict[int, float]) -> list[tuple[int, float]]:
            """With what is reached by leaving out typed letters."""
            out, at, d = [], n, far
            for j, e in sorted(cells.items()):
                while at + 1 < j and d + 1 <= limit:
                    at, d = at + 1, d + 1
                    out.append((at, d))
                if at + 1 == j and d + 1 < e:
                    e = d + 1
                out.append((j, e))
                at, d = j, e
            while at < n and d + 1 <= limit:
                at, d = at + 1, d + 1
                out.append((at, d))
            return out

        def step(row: list[tuple[int, float]], before: list[tuple[int, float]], c: str, last: str) -> list[tuple[int, float]]:
            new: dict[int, float] = {}
            for j, d in row:
                e = d + 1
                if e <= limit and e < new.get(j, far):
                    new[j] = e
                if j < n:
                    if text[j] == c:
                        e = d
                    if e <= limit and e < new.get(j + 1, far):
                        new[j + 1] = e
            for j, d in before:
                if j + 1 < n and text[j + 1] == last and text[j] == c and d + 1 <= limit and d + 1 < new.get(j + 2, far):
                    new[j + 2] = d + 1
            return closed(new)

        # a node, its state, the state before, the last letter, letters since the word began, and at each end of a typed word
        # the least cost at which a beginning of the present word meets it
        todo = [(self.root, closed({0: 0.0}), [], "", 0, {})]
        while todo:
            node, row, before, last, depth, early = todo.pop()
            if not row and not early:
                continue
            for c, child in node.next.items():
                if c == " ":
                    merged = row
                    if early:
                        cells = dict(row)
                        for j, d in early.items():
                            if d <= limit and d < cells.get(j, far):
                                cells[j] = d
                        merged = closed(cells)
                    new = step(merged, before, c, last)
                    if child.entry and new and new[-1][0] == n:
                        for e in child.entry:
                            best[e] = min(best.get(e, far), new[-1][1])
                    todo.append((child, new, row, c, 0, {}))
                else:
                    new = step(row, before, c, last)
                    known = early
                    for j, d in new:
                        if j not in ends:
                            continue
                        cost = d + (0.01 if j in dots else 0.3)
                        if cost <= limit + 0.31 and (j in dots or depth >= 2) and d < 1.5 and cost < known.get(j, far):
                            if d < 0.95 or depth >= (2 if j in dots else 3) or depth == 0 and j in dots and text[j - 1] == c:
                                known = {**known, j: cost}
                    todo.append((child, new, row, c, depth + 1, known))

    def find(self, value: str) -> tuple[int, float | None, int]:
        """(entry or 0, its distance, how many entries are within the distance)"""
        if value in self.exact:
            return self.exact[value], 0.0, 1
        found = self.search(value)
        if not found or len(found) > 1 and found[1][0] - found[0][0] < 0.005:
            return 0, None, len(found)
        return found[0][1], found[0][0], len(found)


def canonicalize(values: DataFrame, id_col: str, value_col: str, entries: DataFrame) -> DataFrame:
    """values (id, value) and entries (canon_id, canonical) -> rec_id, value, canon_id (0: the list has none), distance
    (null for 0), n_candidates. Null values give no row, empty ones 0; repeated rows of one id and value count once;
    nulls among the entries are left out, an empty list answers 0 everywhere. Equal values are searched once.

    The list is read by the driver and its trie is built in every worker: it is meant for lists of up to some hundred
    thousand entries, not for tables that grow with the data."""
    listed = [(int(r.canon_id), r.canonical) for r in entries.select("canon_id", "canonical").dropna().orderBy("canon_id").collect()]
    records = values.select(F.col(id_col).cast("long").alias("rec_id"), F.col(value_col).cast("string").alias("value")).where("rec_id is not null and value is not null")
    # a set number of partitions: the search costs far more than the few bytes by which they would be merged
    records = records.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec_id").distinct()

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(listed)
        for batch in batches:
            got = [trie.find(v) for v in batch["value"]]
            yield batch.assign(canon_id=[g[0] for g in got], distance=[g[1] for g in got], n_candidates=[g[2] for g in got]).astype({"distance": "float64"})

    # a third of all rows may hold one value: they are spread by id, and the worker's cache answers repeats
    return records.mapInPandas(answer, "rec_id long, value string, canon_id int, distance double, n_candidates int")
