"""Ordered rule tables as CASE expressions: the first rule that holds decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoglio.functions.text import has_phrase, stem, tokens

# Type of a document by the words of its path, in order.
FILE_RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("sentenza", "high", ("sentenza", "sent")),
    ("ordinanza", "high", ("ordinanza", "ord")),
    ("decreto", "high", ("decreto", "decr")),
    ("verbale_udienza", "high", ("verbale",)),
    ("verbale_udienza", "medium", ("udienza",)),
    ("memoria", "medium", ("memoria", "note difensive", "note autorizzate")),
    ("istanza", "medium", ("istanza", "richiesta")),
    ("allegato", "low", ("allegato", "all")),
]
# Category of an act by the phrases of its title and description, in order.
ACT_RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("certificato", "high", ("certificato penale", "certificato carichi pendenti", "certificato carico pendente", "certificato casellario", "certificato anagrafico", "certificato di residenza", "certificato medico")),
    ("certificato", "medium", ("certificato",)),
    ("elezione_domicilio", "high", ("elezione di domicilio", "elezione domicilio", "dichiarazione di domicilio", "dichiarazione domicilio")),
    ("nomina_difensore", "high", ("nomina difensore", "nomina del difensore", "difensore d'ufficio", "difensore d ufficio", "nomina avvocato", "designazione difensore")),
    ("sit_sommarie_informazioni", "high", ("sommarie informazioni", "s i t", "persona informata")),
    ("sit_sommarie_informazioni", "medium", ("sit",)),
    ("querela_denuncia", "high", ("querela", "denuncia", "esposto")),
    ("informativa", "high", ("informativa", "cnr", "comunicazione notizia di reato")),
    ("informativa", "medium", ("seguito d indagine", "seguito d'indagine", "seguito indagine", "seguito di indagine", "atti di indagine")),
    ("delega_indagini", "high", ("delega",)),
    ("annotazione", "high", ("annotazione", "annotazioni")),
    ("comunicazione", "high", ("comunicazione 415 bis", "avviso 415 bis", "avviso di conclusione", "avviso conclusione indagini")),
    ("comunicazione", "medium", ("trasmissione atti", "trasmissione degli atti", "comunicazione")),
    ("notifica", "high", ("notifica", "notificazione", "avviso")),
    ("verbale", "high", ("verbale",)),
    ("provvedimento_gip_gup", "high", ()),
    ("provvedimento_pm", "high", ("decreto di sequestro", "decreto sequestro", "decreto di perquisizione", "decreto perquisizione", "decreto di iscrizione", "iscrizione", "decreto di archiviazione", "richiesta di archiviazione", "richiesta di rinvio a giudizio", "decreto di ispezione", "decreto acquisizione", "decreto di effettuazione", "dissequestro")),
    ("provvedimento_pm", "medium", ()),
    ("relazione_servizio", "high", ("relazione di servizio", "relazione servizio")),
    ("documentazione_sanitaria", "high", ("documentazione sanitaria", "referto", "cartella clinica", "pronto soccorso", "perizia medico legale")),
    ("documentazione_amministrativa", "medium", ("documentazione amministrativa", "visura camerale", "visura catastale", "documentazione")),
]
# Two words of different lists that must both stand, or one phrase of a third.
PAIR_RULES = {
    ("provvedimento_gip_gup", "high"): (("gip", "gup", "giudice", "g i p", "g u p"), ("decreto", "ordinanza", "provvedimento", "convalida", "misura", "ammissione"), ("convalida", "incidente probatorio")),
    ("provvedimento_pm", "medium"): (("pm", "p m", "pubblico ministero", "procura"), ("decreto", "provvedimento", "ordine", "richiesta"), ()),
}
# Sort group and priority of each category, and labels of groups, categories and profiles.
SORT_GROUPS = {
    "querela_denuncia": ("querele_denunce", 10), "informativa": ("atti_pg", 20), "delega_indagini": ("atti_pg", 21), "annotazione": ("atti_pg", 22), "relazione_servizio": ("atti_pg", 23), "sit_sommarie_informazioni": ("atti_pg", 30),
    "verbale": ("verbali", 40), "certificato": ("certificati", 50), "documentazione_sanitaria": ("documentazione", 55), "documentazione_amministrativa": ("documentazione", 56), "notifica": ("notifiche", 60), "comunicazione": ("comunicazioni", 65),
    "elezione_domicilio": ("atti_difesa", 70), "nomina_difensore": ("atti_difesa", 71), "provvedimento_pm": ("provvedimenti", 80), "provvedimento_gip_gup": ("provvedimenti", 81), "altro": ("altro", 90),
}
GROUP_LABELS = {
    "querele_denunce": "Querele/Denunce", "atti_pg": "Atti PG", "verbali": "Verbali", "certificati": "Certificati", "documentazione": "Documentazione", "notifiche": "Notifiche", "comunicazioni": "Comunicazioni", "atti_difesa": "Atti difesa",
    "provvedimenti": "Provvedimenti", "altro": "Altro",
}
CATEGORY_LABELS = {
    "certificato": "Certificato", "informativa": "Informativa", "nomina_difensore": "Nomina difensore", "verbale": "Verbale", "notifica": "Notifica/Avviso", "annotazione": "Annotazione", "sit_sommarie_informazioni": "Sommarie informazioni", "delega_indagini": "Delega indagini",
    "comunicazione": "Comunicazione", "provvedimento_pm": "Provvedimento PM", "provvedimento_gip_gup": "Provvedimento GIP/GUP", "elezione_domicilio": "Elezione domicilio", "querela_denuncia": "Querela/Denuncia", "relazione_servizio": "Relazione di servizio",
    "documentazione_sanitaria": "Documentazione sanitaria", "documentazione_amministrativa": "Documentazione amministrativa", "altro": "Altro",
}
PROFILE_LABELS = {"ministeriale_tiap": "Ministeriale TIAP", "immagini_scansioni": "Immagini/Scansioni", "pdf_sciolti": "PDF sciolti", "misto": "Misto", "sconosciuto": "Sconosciuto"}
MARKER = "COMPLETE"


def _chain(rules: list[tuple[Column, Column]], default: Column) -> Column:
    first, *rest = rules
    return reduce(lambda acc, r: acc.when(r[0], r[1]), rest, F.when(*first)).otherwise(default)


def _pair(kind: str, confidence: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))


def file_type(path: Column) -> Column:
    """struct(kind, confidence) of a path by its words; unknown names are sconosciuto/low, null paths too."""
    words = tokens(stem(F.coalesce(path, F.lit(""))))
    rules = [(F.regexp_extract(path, r"[^/\\]*$", 0) == MARKER, _pair("marker_tecnico", "high"))]
    for kind, confidence, phrases in FILE_RULES:
        holds = has_phrase(words, *phrases)
        if phrases == ("verbale",):
            holds = holds | (has_phrase(words, "verb") & has_phrase(words, "ud")) | (words.contains("verbale") & words.contains("udienza"))
        rules.append((holds, _pair(kind, confidence)))
    return _chain(rules, _pair("sconosciuto", "low"))


def act_words(*columns: Column) -> Column:
    """Title and description as folded words; apostrophes stay."""
    from spoglio.functions.text import fold

    return F.trim(F.concat_ws(" ", *[F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9']+", " ")) for c in columns]))


def act_category(title: Column, description: Column) -> Column:
    """struct(kind, confidence) of an act; altro/low where no rule holds or nothing is written."""
    words = act_words(title, description)
    rules = []
    for kind, confidence, phrases in ACT_RULES:
        if (kind, confidence) in PAIR_RULES:
            who, what, alone = PAIR_RULES[kind, confidence]
            holds = has_phrase(words, *who) & has_phrase(words, *what)
            if alone:
                holds = holds | has_phrase(words, *alone)
        else:
            holds = has_phrase(words, *phrases)
        rules.append((holds, _pair(kind, confidence)))
    return _chain(rules, _pair("altro", "low"))


def sort_group(category: Column) -> Column:
    """struct(sort_group, sort_priority, label) by category, altro for an unknown or null one."""
    rows = [(category == c, F.struct(F.lit(g).alias("sort_group"), F.lit(p).alias("sort_priority"), F.lit(GROUP_LABELS[g]).alias("label"))) for c, (g, p) in SORT_GROUPS.items()]
    g, p = SORT_GROUPS["altro"]
    return _chain(rows, F.struct(F.lit(g).alias("sort_group"), F.lit(p).alias("sort_priority"), F.lit(GROUP_LABELS[g]).alias("label")))


def index_confidence(path: Column) -> Column:
    """high, medium or low for a file that may be an index, null for others."""
    from spoglio.functions.text import basename, parent, suffix

    name, ext = basename(path), suffix(basename(path))
    low = F.lower(stem(name))
    any_of = lambda *terms: reduce(lambda a, t: a | low.contains(t), terms, F.lit(False))
    known = ext.isin(".html", ".htm", ".xml", ".txt", ".csv")
    return (
        F.when(~known, None)
        .when(name == "ListaAllegati.html", F.when(F.regexp_extract(parent(path), r"[^/]*$", 0).rlike(r"^\d+$"), "high").otherwise("medium"))
        .when(ext.isin(".html", ".htm", ".xml") & any_of("indice", "index"), "high")
        .when(any_of("fascicolo", "elenco", "documenti", "atti"), "medium")
        .when(any_of("indice", "index"), "low")
    )


def _label(c: Column, labels: dict[str, str], none: str) -> Column:
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    known = F.coalesce(F.when(c != "", c), F.lit(none))
    return F.coalesce(F.try_element_at(named, known), known)


def category_label(category: Column) -> Column:
    return _label(category, CATEGORY_LABELS, "altro")


def profile_label(profile: Column) -> Column:
    return _label(profile, PROFILE_LABELS, "sconosciuto")
