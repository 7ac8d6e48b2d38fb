"""Personal information in free text: anchor expansion.

An Aho-Corasick automaton finds the anchors in one pass over the lower-cased text: at-signs and their spellings, schemes of links,
street words, beginnings of telephone numbers, cues of identity documents and the letter-digit joints that every identity number has,
words that stand before or after a person's name, and words known as parts of names. In fields that hold little but a person the
beginning of the field and of each of its parts are anchors, too. From each anchor a deterministic parser expands to the left or right,
within the line, to the boundaries of an address, number or name, and validates it. A name may stand on the line after its cue, also
with a page number or running header between. Identity numbers are validated by their shape alone: what is captured from scans and typed copies often
fails the control letter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoglio.session import materialize

KINDS = ("name", "email", "phone", "id_number", "address")
# Cues, in lower case.
AT = ("@", "(at)", "[at]", "{at}", " at ", "(a)", " chiocciola ")
STREETS = ("via", "viale", "v.le", "v.", "piazza", "p.zza", "p.za", "piazzale", "p.le", "corso", "c.so", "largo", "l.go", "vicolo", "vico", "strada", "contrada", "c.da", "lungomare", "salita", "borgo", "traversa")
SCHEMES = ("mailto:", "tel:", "callto:", "sms:")
ID_CUES = ("codice fiscale", "cod. fisc.", "c.f.", "carta d'identità", "carta d'identita", "carta di identità", "c.i.", "passaporto", "patente", "tessera", "documento")
PARTS = (":", ",", ";", "(", " - ", " e ", "\n")
PHONE = ("+39", "0039", "(0", "(3", "0", "3")
BEFORE = (
    "avv.", "avv.ssa", "avvocato", "avvocata", "avvocati", "dott.", "dott.ssa", "dr.", "dr.ssa", "dottor", "dottore", "dottoressa", "sig.", "sig.ra", "sigg.", "signor", "signora", "signori", "ing.", "geom.", "prof.", "prof.ssa",
    "teste", "testimone", "testi", "consulente", "perito", "cancelliere", "indagato", "indagata", "imputato", "imputata", "giudice", "presidente", "difensore", "presenti", "contattare", "intestatario", "intestataria", "intestata a", "intestato a",
    "riferito da", "dichiarato da", "risponde che", "persona di", "ufficiale", "agente", "maresciallo", "magistrato", "relatore", "estensore", "giudice:", "presidente:", "got", "gup", "gip", "collegio:", "minore", "coniuge", "fratello", "sorella",
)
AFTER = ("del foro di", "ha dichiarato di abitare", "ha lo studio", "ha trasmesso gli atti", "ha sottoscritto", "ha firmato", "risponde che", "gli aveva mostrato", "le aveva mostrato", ", nata a", ", nato a", ", in possesso", ", codice fiscale", ", assistiti", ", assistito", ", assistita", "ha eletto domicilio")
_NOT_NAMES = frozenset(
    "il lo la i gli le un una di del della dei degli delle da dal e ed in a al alla ha hanno per con che non si su sono è via piazza viale corso largo vicolo tribunale corte giudice pace procura presidente collegio avv dott ssa dr sig sigg got gip gup vpo visto nata nato "
    "risponde gli le aveva entro presso dopo prima oppure tel cell codice fiscale foro teste testimone ufficio sezione pag pagina fascicolo proc prot n r.g registro verbale decreto ordinanza sentenza richiesta avviso all'udienza alla secondo per questi documento esibito".split()
)
_TOKEN = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['’-][A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)*|[A-ZÀ-ÖØ-Þ]{2,}(?:['’-][A-ZÀ-ÖØ-Þ]+)*|[A-ZÀ-ÖØ-Þ]['’][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[A-Z]\.)"
_WORD = re.compile(_TOKEN)
_RUN = re.compile(rf"{_TOKEN}(?: ?{_TOKEN}){{0,5}}")
_INITIALS_BEFORE, _BETWEEN = re.compile(r"(?<![^\W_])(?:[A-Z]\. ?)+$"), re.compile(r" ?(?:[A-Z]\. ?)*")
_E = re.compile(r"e(?=[ \n])")
_PLACE = re.compile(r"\b(?:di|a|in|presso|del|della)\s*$")
_LAST_RUN = re.compile(rf"({_TOKEN}(?: {_TOKEN}){{0,3}})$")
_FURNITURE = re.compile(r"\s*(?:[\[(]?-?\s*\d+\s*-?[\])]?|(?:pag(?:ina|\.)?|f\.|foglio)\s*\d+(?:\s*(?:di|/)\s*\d+)?|.{0,90}\bpag\.?\s*\d+|[A-Z].{0,40}\d+/\d{2,4}\b.{0,60})\s*", re.IGNORECASE)
_TITLE = re.compile(r"(?:dott|avv|dr|prof|sig|ing|geom)\.?(?:ssa|ra|ri)?\.?\s+|(?:GOT|GUP|GIP|VPO|MOT)\s+", re.IGNORECASE)
_AND = re.compile(r"(?: e | ed |, | - |; )")
_EMAIL_LEFT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*$")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_PHONE = re.compile(r"(?:(?:\+39|0039)[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ ./-]?)\d{2,8}(?:[ .-]\d{2,4}){0,3}|(?:\+39|0039)?\d{9,11}")
_ID = re.compile(
    r"(?<![A-Za-z0-9])(?:(?i:[a-z]{3} ?[a-z]{3} ?[0-9lmnpqrstuv]{2}[abcdehlmprst][0-9lmnpqrstuv]{2} ?[a-z][0-9lmnpqrstuv]{3}[a-z])"
    r"|C[A-Z] ?[0-9]{5} ?[A-Z]{2}|[A-Z]{2} ?[0-9]{7}|U1[A-Z] ?[0-9]{6} ?[A-Z]|[A-Z]{2}[0-9]{7}[A-Z])(?![A-Za-z0-9])"
)
_AFTER_CUE = re.compile(r"[ :]*(?:(?:n|nr|num|rilasciat[ao])\.? ?|n° ?|numero )?", re.IGNORECASE)
_NO_DIGIT, _DAY = re.compile(r"\D"), re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][\w'’]*)"
_ADDRESS = re.compile(
    rf"(?i:{'|'.join(re.escape(s) for s in sorted(STREETS, key=len, reverse=True))})"
    rf" (?:(?i:d(?:i|el|ella|ello|ei|egli|elle|a|al|alla)|al|alla|ai) |(?i:dell|all|d)['’])?{_CAP}(?: (?:(?i:di|del|della|dei|delle|e) )?{_CAP}){{0,3}}"
    r"(?:,? ?(?:(?i:n|nr|num|civ)\.? ?|n° ?)?\d{1,4}(?: ?/ ?[A-Za-z]\b|[A-Z]\b|(?i: ?bis| ?ter)\b)?|,? ?(?i:snc|s\.n\.c\.?)\b)(?!\d)"
    r"(?:,? (?i:int|interno|scala|sc|piano)\.? ?\w{1,3}\b)*"
    rf"(?:(?:, ?| - | – | )\d{{5}} {_CAP}(?: (?:(?i:di|del|della|in) )?{_CAP})?|, {_CAP})?"
)


#: A letter and a digit, next to each other or with a blank between: every identity number has such a joint.
JOINTS = tuple(f"{letter}{gap}{digit}" for letter in "abcdefghijklmnopqrstuvwxyz" for gap in ("", " ") for digit in "0123456789")


def automaton(lexicon: frozenset[str] = frozenset(), parts: bool = False) -> ahocorasick.Automaton:
    cues: dict[str, set[str]] = {}
    kinds = [("at", AT), ("scheme", SCHEMES), ("street", STREETS), ("phone", PHONE), ("joint", JOINTS), ("id", ID_CUES), ("before", BEFORE), ("after", AFTER), ("known", lexicon - _NOT_NAMES)]
    for kind, words in [*kinds, ("part", PARTS if parts else ())]:
        for w in words:
            cues.setdefault(w, set()).add(kind)
    a = ahocorasick.Automaton()
    for w, of in cues.items():
        a.add_word(w, (len(w), frozenset(of)))
    a.make_automaton()
    return a


#: The automata of this process, one for each lexicon in use; the last few are kept.
_automata: dict[tuple[frozenset[str], bool], ahocorasick.Automaton] = {}


def _automaton(lexicon: frozenset[str], parts: bool) -> ahocorasick.Automaton:
    got = _automata.get((lexicon, parts))
    if got is None:
        if len(_automata) > 8:
            _automata.clear()
        got = _automata[lexicon, parts] = automaton(lexicon, parts)
    return got


def _skip(text: str, at: int) -> int:
    """Where the words go on after `at`: past blanks and, if the line ends here, past empty lines and furniture."""
    while at < len(text) and text[at] in " \t":
        at += 1
    if at < len(text) and text[at] == "\n":
        while at < len(text):
            end = text.find("\n", at + 1)
            line = text[at + 1 : end if end >= 0 else len(text)]
            if line.strip() and not _FURNITURE.fullmatch(line):
                return at + 1 + len(line) - len(line.lstrip())
            if end < 0:
                return len(text)
            at = end
    return at


def _initial(token: str) -> bool:
    return len(token) == 2 and token[1] == "."


def _trim(run: str) -> str:
    """The leading part of a run of capitalised words that can be a name."""
    out = []
    for m in _WORD.finditer(run):
        if not _initial(m[0]) and m[0].lower().rstrip(".") in _NOT_NAMES:
            break
        out.append(m)
    while len(out) > 1 and _initial(out[-1][0]):
        out.pop()
    if not out or all(len(m[0].rstrip(".")) < 2 for m in out):
        return ""
    return run[: out[min(len(out), 4) - 1].end()]


def _names_from(text: str, at: int, listed: bool = True) -> list[tuple[int, int]]:
    """Names that begin at `at`, past titles; with `listed` also those joined to it by a comma, dash or "e"."""
    out = []
    while True:
        at = _skip(text, at)
        while m := _TITLE.match(text, at):
            at = _skip(text, m.end())
        m = _RUN.match(text, at)
        name = _trim(m[0]) if m else ""
        if not name:
            return out
        out.append((at, at + len(name)))
        at += len(name)
        joined = listed and _AND.match(text, at)
        if not joined and listed:
            ahead = _skip(text, at)
            joined = _E.match(text, ahead) if ahead > at else None
        if not joined:
            return out
        at = joined.end()


def _word_start(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_")


def _id_at(text: str, joint: int) -> tuple[int, int] | None:
    """The identity number around a letter-digit joint: from the first of the word starts to its left from which one reads on over it."""
    starts, at = [], joint
    while at >= 0 and joint - at <= 12 and (text[at].isalnum() or text[at] == " "):
        if text[at] != " " and (at == 0 or not text[at - 1].isalnum()):
            starts.append(at)
        at -= 1
    for start in reversed(starts):
        m = _ID.match(text, start)
        if m and m.end() > joint:
            return m.span()
    return None


def _stretches(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The longest stretches of known words, with initials before and between them; words: where known words stand, in order."""
    first = last = -1
    for a, z in [*words, (len(text) + 2, 0)]:
        if last >= 0 and (a > len(text) or not _BETWEEN.fullmatch(text, last, a)):
            m = _INITIALS_BEFORE.search(text[max(0, first - 20) : first])
            yield first - len(m[0]) if m else first, last
            last = -1
        if last < 0:
            first = a
        last = z


def _name_before(text: str, end: int) -> tuple[int, int] | None:
    """The name that ends at `end`, or at the end of an earlier line above a page's furniture."""
    while end > 0 and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] == "\n":
        lines = text[max(0, end - 400) : end - 1].split("\n")
        while len(lines) > 1 and (not lines[-1].strip() or _FURNITURE.fullmatch(lines[-1])):
            end -= len(lines.pop()) + 1
        end = end - 1
        while end > 0 and text[end - 1] in " \t":
            end -= 1
    m = _LAST_RUN.search(text[max(0, end - 90) : end])
    if not m:
        return None
    run, base = m[1], max(0, end - 90) + m.start()
    tokens = run.split(" ")
    while tokens and (tokens[0].lower().rstrip(".") in _NOT_NAMES or _TITLE.fullmatch(tokens[0] + " ")):
        base += len(tokens.pop(0)) + 1
    name = _trim(" ".join(tokens)) if tokens else ""
    return (base, end) if name and len(name) == end - base and not _PLACE.search(text[max(0, base - 12) : base]) else None


def _names_in(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """The names of one part of a short field, past titles and words that are none."""
    while at < end:
        t = _TITLE.match(text, at, end)
        if t:
            at = t.end()
            continue
        m = _RUN.match(text, at, end)
        name = _trim(m[0]) if m else ""
        if name:
            yield at, at + len(name)
        at += len(name) or (len(_WORD.match(text, at, end)[0]) if m else 1)


class _Taken:
    """Spans that don't overlap, in order."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, str]] = []

    def add(self, a: int, z: int, kind: str) -> None:
        k = bisect_left(self.spans, (a, z, ""))
        if (k == 0 or self.spans[k - 1][1] <= a) and (k == len(self.spans) or self.spans[k][0] >= z):
            insort(self.spans, (a, z, kind))


def find(text: str | None, loose_names: bool = False, lexicon: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in order and without overlap.

    `lexicon` holds words (lower case) known as parts of names: stretches of them are names without a cue as well, as when the
    cue is misread or cut at a line end. `loose_names` is for short fields that hold little but a person: there every run of capitalised words that is
    no title, court or place counts as a name.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not loose_names:
        low = low.replace("\n", " ")
    spans: list[tuple[int, int, str]] = []
    before, after, known, parts = [], [], [], [0]
    joined = -1
    for last, (size, kinds) in _automaton(lexicon, loose_names).iter(low):
        a, z = last - size + 1, last + 1
        if "joint" in kinds and a > joined:
            got = _id_at(text, a)
            if got:
                spans.append((*got, "id_number"))
                joined = got[1]
        if "phone" in kinds and (a == 0 or text[a - 1] in " \n\t:;,<(" ) and not (a and text[a - 1] == "(" and text[a] != "("):
            spans += _phone_at(text, a)
        if "known" in kinds and (a == 0 or not text[a - 1].isalnum()):
            m = _WORD.match(text, a)
            if m and m.end() == z:
                known.append((a, z))
        if "before" in kinds and _word_start(text, a) and not (low[last].isalpha() and z < len(text) and text[z].isalnum()):
            before.append(z + 1 if low[last].isalpha() and z < len(text) and text[z] == "." else z)
        if "after" in kinds:
            after.append(a)
        if "at" in kinds:
            spans += _email_at(text, a, z)
        if "street" in kinds and _word_start(text, a):
            m = _ADDRESS.match(text, a)
            if m:
                spans.append((a, m.end(), "address"))
        if "id" in kinds and _word_start(text, a):
            m = _ID.match(text, _AFTER_CUE.match(text, z).end())
            if m:
                spans.append((*m.span(), "id_number"))
        if "scheme" in kinds:
            own = _EMAIL_LEFT.match(text, z)
            spans += _phone_at(text, z) or (_email_at(text, own.end(), own.end() + 1) if own else [])
        if "part" in kinds:
            parts += [a, z]
    order = {"email": 0, "address": 1, "id_number": 2, "phone": 3}
    taken = _Taken()
    for a, z, kind in sorted(set(spans), key=lambda s: (order[s[2]], s[0], -s[1])):
        taken.add(a, z, kind)
    pieces, at = [], 0
    for a, z, _ in taken.spans:  # what is known already is no part of a name
        pieces += [text[at:a], "0" * (z - a)]
        at = z
    text = "".join(pieces) + text[at:]
    names = [n for z in before for n in _names_from(text, z)]
    names += [n for end in after if (n := _name_before(text, end))]
    if loose_names:
        cuts = sorted({*parts, len(text)})
        names += [n for a, z in zip(cuts, cuts[1:]) for n in _names_in(text, a, z)]
    for a, z in sorted(set(names), key=lambda s: (s[0], -s[1])):
        taken.add(a, z, "name")
    for a, z in _stretches(text, [(a, z) for a, z in known if text[a] != "0"]):
        taken.add(a, z, "name")
    return taken.spans


def _email_at(text: str, left: int, right: int) -> list[tuple[int, int, str]]:
    """The address around an at-sign that stands at left..right."""
    while left > 0 and text[left - 1] == " ":
        left -= 1
    while right < len(text) and text[right] == " ":
        right += 1
    own, domain = _EMAIL_LEFT.search(text, max(0, left - 80), left), _EMAIL_RIGHT.match(text, right)
    return [(own.start(), domain.end(), "email")] if own and domain else []


def _phone_at(text: str, a: int) -> list[tuple[int, int, str]]:
    m = _PHONE.match(text, a)
    if not m or (m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] in "/" or text[m.end()] in "-." and text[m.end() + 1 : m.end() + 2].isdigit())):
        return []
    digits = _NO_DIGIT.sub("", m[0])
    digits = digits[4:] if digits.startswith("0039") else digits[2:] if m[0].startswith("+39") else digits
    return [(a, m.end(), "phone")] if 9 <= len(digits) <= 11 and digits[0] in "03" and not _DAY.fullmatch(m[0]) else []


def redact(text: str | None, loose_names: bool = False, lexicon: frozenset[str] = frozenset()) -> str | None:
    """The text with each finding replaced by its kind in square brackets; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, z, kind in find(text, loose_names, lexicon):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join(out) + text[at:]


def name_words(texts: DataFrame, text_col: str, least: int = 3) -> DataFrame:
    """word (lower case): the words that at least `least` times, and more often than not, stand in a name found by its cue, over all
    the texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, named = Counter(), Counter()
        for batch in batches:
            for t in batch["text"]:
                every.update(w.lower() for w in _WORD.findall(t))
                for a, z, kind in find(t):
                    if kind == "name":
                        named.update(w.lower() for w in _WORD.findall(t[a:z]) if len(w) > 2)
        yield pd.DataFrame([(w, named[w], n) for w, n in every.items()], columns=["word", "named", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInPandas(count, "word string, named long, n long")
    counted = counted.groupBy("word").agg(F.sum("named").alias("named"), F.sum("n").alias("n"))
    return counted.where((F.col("named") >= least) & (2 * F.col("named") > F.col("n"))).select("word")


def known_names(records: DataFrame, words: DataFrame, most: int = 200_000) -> tuple[DataFrame, frozenset[str]]:
    """records (with a column text) and the list of name words. Up to `most` words are sent to every task, as given names and
    surnames are few; of a longer list each text gets its own words in a column __names by a join, with the same result."""
    words = materialize(words, "names")
    if words.count() <= most:
        return records, frozenset(r.word for r in words.collect())

    def capitalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [sorted({w.lower() for w in _WORD.findall(t)}) for t in batch["text"]]
            yield pd.DataFrame({"__text": batch["__text"].repeat([len(o) for o in own]).to_numpy(), "word": [w for o in own for w in o]})

    keyed = records.withColumn("__text", F.sha2("text", 256))
    own = keyed.where("text is not null").select("__text", "text").mapInPandas(capitalised, "__text string, word string").distinct()
    own = own.join(words, "word").groupBy("__text").agg(F.collect_list("word").alias("__names"))
    return keyed.join(own, "__text", "left").drop("__text"), frozenset()


def _lexicon(names: pd.Series) -> frozenset[str]:
    """The name words of all texts of a batch; a word that stands in a text is among its own."""
    return frozenset(w for own in names if own is not None for w in own)


def find_personal_information(records: DataFrame, id_col: str, text_col: str, loose_names: bool = False, lexicon: frozenset[str] | None = None, most: int = 200_000) -> DataFrame:
    """rec_id, kind, value of each different value in each record. Null and empty texts give no row;
    repeated rows count once. Texts stay where they are; only findings are shuffled. Without a lexicon, one is
    made from the names that the cues find in all records, and a second pass uses it (`known_names` says how)."""
    source = records.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("text")).where("rec_id is not null and text is not null")
    if lexicon is None:
        source, lexicon = known_names(source, name_words(source, "text"), most)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = _lexicon(batch["__names"]) if "__names" in batch else lexicon
            rows = [(i, kind, t[a:z]) for i, t in zip(batch["rec_id"], batch["text"]) for a, z, kind in find(t, loose_names, known)]
            yield pd.DataFrame(rows, columns=["rec_id", "kind", "value"])

    return source.mapInPandas(look, "rec_id long, kind string, value string").distinct()


def redact_column(records: DataFrame, text_col: str, loose_names: bool = False, words: DataFrame | None = None, most: int = 200_000) -> DataFrame:
    """All rows and columns as they are, but personal information in `text_col` replaced by placeholders; `words`: the name words to use."""
    rest = [c for c in records.columns if c != text_col]
    texts, lexicon = records.select(*rest, F.col(text_col).cast("string").alias("text")), frozenset()
    if words is not None:
        texts, lexicon = known_names(texts, words, most)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, names: pd.Series) -> pd.Series:
        known = lexicon or _lexicon(names)
        return texts.map(lambda t: redact(t, loose_names, known), na_action="ignore")

    names = F.col("__names") if "__names" in texts.columns else F.array().cast("array<string>")
    out = texts.withColumn("text", clean("text", names))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(c) for c in records.columns])
