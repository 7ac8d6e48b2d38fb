"""Fields of judgments: the first line that holds a field decides. The lines of a text stay together, so one narrow pass gives all fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoglio.functions import text as T
from spoglio.operators.markdown import filled, line_array, strip

# The wording of a judgment.
_CITY = r"[A-Za-zÀ-ÿ'‘’ ]+"
COURTS = (
    rf"Corte\s+di\s+Assise\s+d['‘’]Appello\s+di\s+{_CITY}", rf"Corte\s+di\s+Assise\s+di\s+Appello\s+di\s+{_CITY}", rf"Corte\s+di\s+Assise\s+di\s+{_CITY}", rf"Corte\s+d['‘’]Appello\s+di\s+{_CITY}",
    rf"Giudice\s+di\s+Pace\s+di\s+{_CITY}", rf"Tribunale\s+(?:ordinario\s+)?di\s+{_CITY}",
)
AUTHORITY = r"(?iu)\b(" + "|".join(COURTS) + ")"
AFTER_AUTHORITY = r"(?iu)\s+(?:sezione|in\s+composizione|composizione|penale|civile|ha\b|pronuncia\b|emette\b|in\s+persona\b|nella\s+persona\b)\b.*$"
JUDGE = r"(?iu)\b(?:giudice(?:\s+monocratico)?|in\s+persona\s+del\s+giudice)\s+(?:dott\.ssa|dott\.?|dr\.ssa|dr\.?)?\s*([A-ZÀ-Ý][A-Za-zÀ-ÿ'’.-]+(?:\s+[A-ZÀ-Ý][A-Za-zÀ-ÿ'’.-]+){0,3})"
SENTENCE = r"(?iu)\bsentenza\s*(?:n\.?|numero)?\s*[:.]?\s*([0-9]+(?:/[0-9]{2,4})?)\b"
PROCEEDING = r"(?iu)\b(?:r\.?\s*g\.?\s*n\.?\s*r\.?|r\.?\s*g\.?|n\.?\s*r\.?\s*g\.?|proc(?:edimento)?(?:\s+penale)?)\s*(?:n\.?|numero)?\s*[:.]?\s*([0-9]+(?:/[0-9]{2,4})?)\b"
DATE = "(?iu)" + T.TEXT_DATE
_DAYS_NUMBER = r"(?:[0-9]{1,3}|trenta|quarantacinque|sessanta|novanta)"
DEADLINE = rf"(?iu)\b(?:(?:entro|in|nel\s+termine\s+di|termine\s+di|termine\s+per\s+il\s+deposito\s+della\s+motivazione\s+di)\s+({_DAYS_NUMBER})\s+giorni|giorni\s+({_DAYS_NUMBER}))\b"
DAYS = {"trenta": "30", "quarantacinque": "45", "sessanta": "60", "novanta": "90"}
START = r"(?iu)^(?:p\.?\s*q\.?\s*m\.?|per\s+questi\s+motivi|dispositivo)\s*[:.]?$"
BLOCKS = (r"(?iu)^(?:#{1,6}\s*)?Blocco\s+\d+\s*-\s*Pagine\s+(\d+)\s*[-–]\s*\d+", r"(?iu)^<!--\s*Blocco\s+\d+:\s*pagine\s+originali\s+(\d+)\s*[-–]\s*\d+\s*-->$", r"(?iu)\bpag(?:ina)?\.?\s+(\d+)\b")
_E = r"[eéè'‘’]+"
OUTCOMES = {
    "condanna": r"(?iu)\b(?:condanna|condannato|dichiara\s+.+?\bcolpevole)\b",
    "assoluzione": rf"(?iu)\b(?:assolve|assolto|assoluzione|il\s+fatto\s+non\s+sussiste|perch{_E}\s+il\s+fatto\s+non\s+sussiste|perch{_E}\s+non\s+costituisce\s+reato|per\s+non\s+aver\s+commesso\s+il\s+fatto|il\s+fatto\s+non\s+{_E}\s+previsto\s+dalla\s+legge\s+come\s+reato)\b",
    "proscioglimento / non doversi procedere": r"(?iu)\b(?:proscioglie|proscioglimento|non\s+doversi\s+procedere|estinzione\s+del\s+reato|estinto\s+il\s+reato|prescrizione|remissione\s+(?:della\s+)?querela|difetto\s+di\s+querela)\b",
    "patteggiamento": r"(?iu)\b(?:patteggiamento|pena\s+(?:concordata|su\s+richiesta)|applica\s+la\s+pena\s+(?:concordata|su\s+richiesta)|art\.?\s*444\s*c\.?\s*p\.?\s*p\.?)\b",
}
WINDOW = 35
ALERTS = {
    "always": "Parser euristico: non calcola termini di impugnazione e non sostituisce la verifica legale.",
    "deposit": "Data di deposito assente: verificare fascicolo e cancelleria prima di valutare scadenze.",
    "deadline": "Motivazione riservata senza termine rilevato: dato da controllare sul provvedimento originale.",
    "outcome": "Dispositivo con indicatori contrastanti o multipli: classificazione da verificare manualmente.",
}
# The words that stand for a kind of outcome, all of which must be in the phrase, in order of precedence.
KEYWORDS = (
    (("condann",), "condanna"), (("colpevole",), "colpevole"), (("assolv",), "assoluzione"), (("fatto non sussiste",), "fatto non sussiste"), (("non costituisce reato",), "non costituisce reato"), (("non aver commesso il fatto",), "non aver commesso il fatto"),
    (("non", "previsto", "legge"), "fatto non previsto dalla legge come reato"), (("prosciogl",), "proscioglimento"), (("non doversi procedere",), "non doversi procedere"), (("estinzione", "reato"), "estinzione reato"), (("estinto", "reato"), "estinzione reato"),
    (("prescrizione",), "prescrizione"), (("remissione", "querela"), "remissione querela"), (("difetto", "querela"), "difetto di querela"), (("patteggiamento",), "patteggiamento"), (("pena concordata",), "patteggiamento"), (("pena su richiesta",), "patteggiamento"), (("art", "444"), "patteggiamento"),
)


def clean_line(c: Column) -> Column:
    """A line without heading marks and emphasis, white space collapsed."""
    return T.squeeze(F.regexp_replace(F.regexp_replace(strip(c), r"^#{1,6}\s+", ""), r"\*\*|__|`", ""))


def clean_value(c: Column) -> Column:
    return F.btrim(T.squeeze(c), F.lit(" \t-–—:;,."))


def snippet(n: Column, page: Column, text: Column, most: int = 150) -> Column:
    """Where a field was read: page if known, line, and the line's beginning."""
    return F.concat(F.coalesce(F.concat(F.lit("pagina "), page, F.lit(", ")), F.lit("")), F.lit("riga "), n, F.lit(": "), T.shorten(clean_value(text), most, strip=True, mark="…"))


def _page(t: Column) -> Column:
    """The page a line names: by its block mark, else by the word for page."""
    by_block = F.coalesce(*[F.regexp_extract(t, p, 1).try_cast("int") for p in BLOCKS[:2]])
    return F.when(t.rlike("(?i)pag"), F.coalesce(by_block, F.regexp_extract(t, BLOCKS[2], 1).try_cast("int")))


def judgment_fields(texts: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """One row for each text: detected, and value, confidence and source of ten fields, all null where no judgment is detected; then dispositive_keywords,
    missing_fields and warnings, empty where none is.

    A text is a judgment if it scores three or more: two for an authority, one each for a number, a date, an outcome, the word sentenza and
    an operative part. Null texts give no row. Each pattern is matched once against every line, its value taken from the deciding line only.
    """
    df = texts.where(F.col(text).isNotNull()).select(key, F.transform(line_array(F.col(text)), clean_line).alias("__t"))
    df = df.select(key, F.transform(F.arrays_zip(F.col("__t").alias("t"), filled(F.col("__t"), _page).alias("page")), lambda x, i: F.struct((i + 1).alias("n"), x["page"].alias("page"), x["t"].alias("t"), F.lower(x["t"]).alias("low"))).alias("__r"))
    rows, t, low = F.col("__r"), lambda x: x["t"], lambda x: x["low"]
    first = lambda holds, last=False: F.try_element_at(F.filter(rows, holds), F.lit(-1 if last else 1))
    has = lambda pattern: lambda x: t(x).rlike(pattern)
    both = lambda *fs: lambda x: reduce(lambda a, b: a & b, [f(x) for f in fs])
    motive = lambda x: low(x).contains("motiv")
    deposit = lambda x: low(x).rlike(r"\bdeposit(?:ata|ato|o)\b") & ~(low(x).contains("termine") & low(x).contains("giorni"))
    judge_of = lambda x: T.null_if_empty(F.trim(F.regexp_replace(clean_value(T.first_match(t(x), JUDGE, 1)), r"(?iu)\b(?:ha|pronunciato|emesso|la|seguente)\b.*$", "")))
    is_judge = lambda x: ~low(x).contains("giudice di pace") & judge_of(x).isNotNull() & ~F.lower(judge_of(x)).isin("monocratico", "pace")
    found = {
        "a": first(has(AUTHORITY)), "single": first(lambda x: low(x).rlike(r"\bmonocratic[ao]\b")), "bench": first(lambda x: low(x).contains("collegiale") & low(x).rlike(r"\bcollegiale\b")), "judge": first(lambda x: low(x).contains("giudice") & is_judge(x)),
        "sentence": first(lambda x: low(x).contains("sentenza") & has(SENTENCE)(x)), "proceeding": first(lambda x: has(PROCEEDING)(x) & ~low(x).contains("sentenza")), "any": first(has(DATE)),
        "named": first(lambda x: low(x).rlike(r"\b(?:udienza|pronuncia|dispositivo|deciso|decisione)\b") & has(DATE)(x)), "reserved": first(lambda x: motive(x) & low(x).rlike(r"\b(?:riserv|contestual)"), last=True),
        "deadline": first(lambda x: motive(x) & has(DEADLINE)(x)), "deposit": first(lambda x: deposit(x) & has(DATE)(x)), "head": first(has(START)),
    }
    says = F.exists(rows, lambda x: low(x).contains("sentenza"))
    court = F.exists(F.slice(rows, 1, 40), lambda x: low(x).rlike(r"\btribunale\b"))
    df = df.select(key, "__r", says.alias("says"), court.alias("court"), *[c.alias(name) for name, c in found.items()])
    # the operative part: its first line and the 34 after it, up to a heading
    part = F.slice(rows, F.coalesce(F.col("head.n"), F.lit(1)), F.when(F.col("head").isNotNull(), WINDOW).otherwise(0))
    df = df.withColumn("__p", F.array_join(F.transform(part, t), "\n")).drop("__r")
    hits = {name: F.transform(F.regexp_extract_all("__p", F.lit(pattern), 0), lambda m: clean_value(F.lower(m))) for name, pattern in OUTCOMES.items()}
    df = df.select("*", *[h.alias(f"o{i}") for i, h in enumerate(hits.values())])
    every = [F.col(f"o{i}") for i in range(len(OUTCOMES))]
    families = sum((F.size(o) > 0).cast("int") for o in every)
    only = F.coalesce(*[F.when(F.size(o) > 0, F.lit(name)) for o, name in zip(every, OUTCOMES)])
    bare = F.col("__p").rlike(START)  # the part is its first line alone
    outcome = F.when(families > 1, "ambiguo").when(families == 1, only).when(bare, "altro")
    value = lambda f, pattern, group=1: T.first_match(F.col(f"{f}.t"), pattern, group)
    score = 2 * F.col("a").isNotNull().cast("int") + F.col("sentence").isNotNull().cast("int") + F.col("any").isNotNull().cast("int") + outcome.isNotNull().cast("int") + F.coalesce(F.col("says").cast("int"), F.lit(0)) + F.col("head").isNotNull().cast("int")
    field = lambda f, confidence, of: F.when(F.col(f).isNotNull(), F.struct(of.alias("value"), F.lit(confidence).alias("confidence"), snippet(F.col(f"{f}.n"), F.col(f"{f}.page"), F.col(f"{f}.t")).alias("source")))
    note = lambda what, confidence, source: F.struct(F.lit(what).alias("value"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
    authority = clean_value(F.regexp_replace(value("a", AUTHORITY), AFTER_AUTHORITY, ""))
    deadline = F.coalesce(value("deadline", DEADLINE, 1), value("deadline", DEADLINE, 2))
    for word, days in DAYS.items():
        deadline = F.when(F.lower(deadline) == word, days).otherwise(deadline)
    low_a = F.lower(authority)
    composition = F.coalesce(
        field("single", "high", F.lit("monocratica")), field("bench", "high", F.lit("collegiale")), F.when(low_a.contains("giudice di pace"), field("a", "high", F.lit("Giudice di Pace"))), F.when(low_a.contains("corte di assise"), field("a", "high", F.lit("Corte d'Assise"))),
        F.when(F.col("court"), note("non rilevata", "low", "intestazione sentenza senza composizione esplicita")))
    out = df.select(
        key, (score >= 3).alias("detected"), field("a", "high", authority).alias("authority"), composition.alias("composition"), field("judge", "medium", judge_of(F.col("judge"))).alias("judge"), field("sentence", "high", value("sentence", SENTENCE)).alias("sentence_number"),
        field("proceeding", "high", value("proceeding", PROCEEDING)).alias("proceeding_number"), F.coalesce(field("named", "high", value("named", DATE)), field("any", "low", value("any", DATE))).alias("hearing_or_decision_date"),
        F.coalesce(field("reserved", "high", F.when(F.col("reserved.low").rlike(r"\briserv"), "riservata").otherwise("contestuale")), note("non rilevata", "low", "nessuna formula di motivazione riconosciuta")).alias("motivation_type"), field("deadline", "high", F.concat(deadline, F.lit(" giorni"))).alias("motivation_deadline"),
        field("deposit", "high", value("deposit", DATE)).alias("deposit_date"),
        F.when(outcome.isNotNull(), F.struct(outcome.alias("value"), F.when(outcome.isin("ambiguo", "altro"), "low").otherwise("high").alias("confidence"), snippet(F.col("head.n"), F.col("head.page"), F.col("head.t")).alias("source"))).alias("outcome"),
        F.array_distinct(F.concat(*every)).alias("dispositive_keywords"),
    )
    out = out.select(key, "detected", *[F.when(F.col("detected"), F.col(c)).alias(c) for c in FIELDS], F.when(F.col("detected"), F.col("dispositive_keywords")).otherwise(_none()).alias("dispositive_keywords"))
    return out.withColumn("missing_fields", F.when(F.col("detected"), _missing()).otherwise(_none())).withColumn("warnings", F.when(F.col("detected"), alerts()).otherwise(_none()))


def _none() -> Column:
    return F.array().cast("array<string>")


FIELDS = ["authority", "composition", "judge", "sentence_number", "proceeding_number", "hearing_or_decision_date", "motivation_type", "motivation_deadline", "deposit_date", "outcome"]
_LABELS = {
    "authority": "autorità giudiziaria", "composition": "composizione", "judge": "giudice", "sentence_number": "numero sentenza", "proceeding_number": "numero procedimento", "hearing_or_decision_date": "udienza / dispositivo", "deposit_date": "deposito", "outcome": "dispositivo",
}


def _missing() -> Column:
    lacks = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit("non rilevata")) == "non rilevata"
    parts = [F.when(lacks(c), F.lit(label)) for c, label in _LABELS.items()]
    parts += [F.when(lacks("motivation_type"), F.lit("motivazione")), F.when((F.col("motivation_type.value") == "riservata") & F.col("motivation_deadline").isNull(), F.lit("termine motivazione"))]
    return F.array_compact(F.array(*parts))


def alerts() -> Column:
    """What a reader must verify, of a detected judgment's fields."""
    reserved = (F.col("motivation_type.value") == "riservata") & F.col("motivation_deadline").isNull()
    say = lambda holds, which: F.when(holds, F.lit(ALERTS[which]))
    return F.array_compact(F.array(F.lit(ALERTS["always"]), say(F.col("deposit_date").isNull(), "deposit"), say(reserved, "deadline"), say(F.col("outcome.value") == "ambiguo", "outcome")))


def missing_fields(found: DataFrame, key: str) -> DataFrame:
    """key, missing: what a detected judgment lacks, one row each."""
    return found.where("detected").select(key, F.explode(_missing()).alias("missing"))


def keyword_kind(phrase: Column, most: int = 40) -> Column:
    """The kind of outcome a phrase of the operative part stands for, the phrase itself if none, null for an empty one."""
    t = T.null_if_empty(F.lower(clean_value(phrase)))
    kind = F
    for words, name in KEYWORDS:
        kind = kind.when(reduce(lambda a, b: a & b, [t.contains(w) for w in words]), F.lit(name))
    return kind.otherwise(T.shorten(t, most, strip=True))


def keyword_counts(found: DataFrame, key: str, phrases: str = "dispositive_keywords") -> DataFrame:
    """keyword, n_judgments: in how many judgments each kind of outcome is named."""
    kinds = found.select(key, F.explode(F.array_distinct(F.transform(phrases, lambda x: keyword_kind(x)))).alias("keyword")).where("keyword is not null")
    return kinds.distinct().groupBy("keyword").agg(F.count("*").alias("n_judgments"))


_CARD = (
    ("## Dati provvedimento", (("Autorità giudiziaria", "authority"), ("Composizione", "composition"), ("Giudice", "judge"), ("Numero sentenza", "sentence_number"), ("Numero procedimento", "proceeding_number"))),
    ("## Date rilevanti", (("Udienza / dispositivo", "hearing_or_decision_date"), ("Motivazione", "motivation_type"), ("Termine motivazione", "motivation_deadline"), ("Deposito", "deposit_date"))),
    ("## Esito", (("Dispositivo", "outcome"),)),
)


def card(found: DataFrame, key: str) -> DataFrame:
    """key, card: the review card of each text in Markdown, a line for each field, its confidence in brackets unless high, then keywords, alerts and what is missing."""
    shown = lambda c: F.coalesce(F.when(F.col(f"{c}.confidence") == "high", F.col(f"{c}.value")).otherwise(F.concat(F.col(f"{c}.value"), F.lit(" ("), F.col(f"{c}.confidence"), F.lit(")"))), F.lit("non rilevato"))
    listed = lambda c, none: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ", ")).otherwise(none)
    rows = [F.lit("# Scheda sentenza")]
    for title, fields in _CARD:
        rows += [F.lit(""), F.lit(title), *[F.concat(F.lit(f"- {label}: "), shown(c)) for label, c in fields]]
    rows += [F.concat(F.lit("- Parole chiave: "), listed("dispositive_keywords", "non rilevate")), F.lit(""), F.lit("## Alert impugnazione")]
    warned = F.when(F.coalesce(F.size("warnings"), F.lit(0)) > 0, F.transform("warnings", lambda w: F.concat(F.lit("- "), w))).otherwise(F.array(F.lit("- Nessun alert euristico rilevato.")))
    last = F.concat(F.lit("- Dati mancanti da verificare: "), listed("missing_fields", "nessuno tra i campi MVP"))
    whole = F.array_join(F.concat(F.array(*rows), warned, F.array(last)), "\n")
    return found.select(key, F.when(F.col("detected"), whole).otherwise("# Scheda sentenza\n\nTesto non riconosciuto come sentenza.").alias("card"))


def with_card(texts: DataFrame, cards: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """The texts with their review card before them; a text without a card stays as it is."""
    joined = texts.join(cards.select(key, "card"), key, "left")
    return joined.withColumn(text, F.coalesce(F.concat("card", F.lit("\n\n---\n\n"), F.regexp_replace(text, r"^\n+", "")), F.col(text))).drop("card")


def manifest_entry(found: DataFrame, key: str, output_file: Column, most: int = 20) -> DataFrame:
    """key, judgment_analysis: what a job's manifest keeps of the analysis, without sources; long values cut, lists of `most` at most."""
    short = lambda c, n: T.shorten(T.null_if_empty(clean_value(c)), n, strip=True)
    texts = lambda c, n: F.slice(F.array_compact(F.transform(c, lambda x: short(x, n))), 1, most)
    fields = F.struct(*[F.struct(short(F.col(f"{c}.value"), 120).alias("value"), F.coalesce(F.col(f"{c}.confidence"), F.lit("low")).alias("confidence")).alias(c) for c in FIELDS])
    return found.select(key, F.struct(
        F.lit(True).alias("enabled"), F.col("detected"), output_file.alias("output_file"), fields.alias("fields"), F.slice(F.array_distinct(F.array_compact(F.transform("dispositive_keywords", lambda x: keyword_kind(x)))), 1, most).alias("dispositive_keywords"),
        texts("missing_fields", 120).alias("missing_fields"), texts("warnings", 240).alias("warnings")).alias("judgment_analysis"))
