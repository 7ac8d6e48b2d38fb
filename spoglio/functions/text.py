"""Text and path expressions, all of them Catalyst columns unless marked."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin() -> tuple[str, str]:
    """Accented letters up to U+024F with a single base letter, and these base letters, from the Unicode tables."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFKD", chr(code).casefold()) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _latin()


def fold(c: Column) -> Column:
    """Lower case without accents, for Latin letters; stays in the JVM. Sharp s becomes ss."""
    return F.replace(F.translate(F.lower(c), _FROM, _TO), F.lit("ß"), F.lit("ss"))


def fold_any(c: Column) -> Column:
    """Compatibility decomposition, case folding and removal of combining marks, for any script (Arrow batches)."""

    def one(t: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(x))

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return each(c)


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def null_if_empty(c: Column) -> Column:
    """Safe inside array functions, where nullif isn't."""
    return F.when(c != "", c)


def tokens(c: Column) -> Column:
    """Folded letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def has_phrase(c: Column, *phrases: str) -> Column:
    """Whether any of the phrases stands in `c` as whole words."""
    padded, out = F.concat(F.lit(" "), c, F.lit(" ")), F.lit(False)
    for p in phrases:
        out = out | padded.contains(f" {p} ")
    return out


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match or null."""
    return null_if_empty(F.regexp_extract(c, pattern, group))


# The forms of a date in an index or a judgment.
INDEX_DATE = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}-\d{2}-\d{2})\b"
MONTHS = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
TEXT_DATE = rf"\b(\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}})\b"


def first_date(c: Column) -> Column:
    return first_match(c, INDEX_DATE, 1)


def first_pdf(c: Column) -> Column:
    """The first run without blanks that ends in .pdf, without surrounding punctuation."""
    return null_if_empty(F.btrim(F.regexp_extract(c, r"(?i)(\S+\.pdf)", 1), F.lit("\"'()[]{}<>,;:")))


def shorten(c: Column, n: int, strip: bool = False, mark: str = "...") -> Column:
    """At most n characters, the cut marked."""
    kept = F.left(c, F.lit(n - len(mark)))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(kept) if strip else kept, F.lit(mark)))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    """The last segment that is no dot segment, null if there is none."""
    parts = F.filter(F.split(slashes(path), "/"), lambda s: (s != "") & (s != ".") & (s != ".."))
    return F.try_element_at(parts, F.lit(-1))


def parent(path: Column) -> Column:
    return F.regexp_replace(slashes(path), r"/?[^/]*$", "")


def top_segment(path: Column) -> Column:
    return F.try_element_at(F.split(slashes(path), "/"), F.lit(1))


def suffix(name: Column) -> Column:
    """The lower-cased extension with its dot; a leading dot begins no extension."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/.])(\.[^./]+)$", "")


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha1(slashes(path)), 1, 12))


def leading_number(name: Column) -> Column:
    """One to six digits that open the name and no more digits follow."""
    return null_if_empty(F.regexp_extract(name, r"^(\d{1,6})(?:\D|$)", 1)).try_cast("int")


def reference_path(ref: Column) -> Column:
    """A reference as a path: slashes, no scheme, host, query or fragment, percent-decoded where that is valid."""
    clean = F.trim(slashes(ref))
    path = F.regexp_replace(F.regexp_replace(clean, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", ""), r"[?#].*$", "")
    path = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]+:(?!/)", "")
    return F.trim(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def safe_reference(ref: Column) -> Column:
    """A reference without what lies outside the folder: absolute paths, URLs and paths through `..` keep their name only."""
    path = reference_path(ref)
    outside = ref.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*:") | path.rlike(r"^(?:/|[A-Za-z]:)")
    inner = F.regexp_replace(path, r"^\./", "")
    return F.when(outside | F.array_contains(F.split(inner, "/"), ".."), basename(path)).otherwise(null_if_empty(inner))


def folded_name(path: Column) -> Column:
    """The name of a path for loose comparison: folded, blanks, dashes and underscores alike."""
    return F.trim(F.regexp_replace(fold(basename(path)), r"[\s_-]+", " "))


def human_size(n: Column) -> Column:
    """B, KB or MB with one decimal, ties to even."""
    one = lambda d, unit: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(d)), 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, one(1024, "KB")).otherwise(one(1024 * 1024, "MB"))


def day_key(c: Column) -> Column:
    """struct(y, m, d, odd) of dd/mm/yyyy or an ISO date, no calendar check; 9999/99/99 for anything else. `odd`: the year is
    outside 1950-2099."""
    t = F.trim(c)
    dmy, iso = r"^(\d{2})/(\d{2})/(\d{4})$", r"^(\d{4})-(\d{2})-(\d{2})$"
    part = lambda i, j: F.coalesce(null_if_empty(F.regexp_extract(t, dmy, i)), null_if_empty(F.regexp_extract(t, iso, j))).try_cast("int")
    y = part(3, 1)
    return F.struct(F.coalesce(y, F.lit(9999)).alias("y"), F.coalesce(part(2, 2), F.lit(99)).alias("m"), F.coalesce(part(1, 3), F.lit(99)).alias("d"), F.coalesce((y < 1950) | (y > 2099), F.lit(False)).alias("odd"))
