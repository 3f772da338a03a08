"""Printed names, nationalities and dates, put so that they can be held against a machine-readable zone."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.mrz import let

#: Fixed values of ICAO Doc 9303: letters that become several, and the other ways that it allows for some.
SEVERAL = {"Ä": "AE", "Å": "AA", "Æ": "AE", "Ĳ": "IJ", "Ö": "OE", "Ø": "OE", "Œ": "OE", "Ü": "UE", "ß": "SS", "ẞ": "SS", "Þ": "TH"}
SINGLE = {"Ä": "A", "Å": "A", "Ö": "O", "Ø": "O", "Ü": "U"}
MARKED = {"Ñ": "NXX", "Ü": "UXX"}
#: Letters without a base letter in their decomposition.
OTHERS = {"Đ": "D", "Ð": "D", "Ħ": "H", "ı": "I", "Ŀ": "L", "Ł": "L", "Ŋ": "N", "Ŧ": "T"}
#: Names of months and what they are shortened to, in English, German, Spanish and French.
MONTHS = (
    ("january", "jan", "januar", "jänner", "enero", "ene", "janvier", "janv"),
    ("february", "feb", "februar", "febrero", "février", "févr", "fév"),
    ("march", "mar", "märz", "mär", "mrz", "marzo", "mars"),
    ("april", "apr", "abril", "abr", "avril", "avr"),
    ("may", "mai", "mayo"),
    ("june", "jun", "juni", "junio", "juin"),
    ("july", "jul", "juli", "julio", "juillet", "juil"),
    ("august", "aug", "agosto", "ago", "août"),
    ("september", "sep", "sept", "septiembre", "septembre"),
    ("october", "oct", "oktober", "okt", "octubre", "octobre"),
    ("november", "nov", "noviembre", "novembre"),
    ("december", "dec", "dezember", "dez", "diciembre", "dic", "décembre", "déc"),
)
#: A few names of countries and nationalities for their codes; callers give the rest.
COUNTRIES = {
    "UTO": ("utopia", "utopian"), "D": ("germany", "german", "deutschland", "deutsch"), "FRA": ("france", "french", "française", "français"), "ESP": ("spain", "spanish", "españa", "española", "español"),
    "GBR": ("united kingdom", "great britain", "british", "british citizen"), "USA": ("united states", "united states of america", "american"), "ITA": ("italy", "italian", "italia", "italiana"),
    "IND": ("india", "indian"), "AUT": ("austria", "austrian", "österreich"), "CHE": ("switzerland", "swiss", "schweiz", "suisse"), "NLD": ("netherlands", "dutch", "nederlandse"), "PRT": ("portugal", "portuguese", "portuguesa"),
}


def _base_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters that are left when the marks go."""
    pairs = dict(OTHERS)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0].upper()
        if chr(code) not in SEVERAL and "A" <= base <= "Z":
            pairs.setdefault(chr(code), base)
    return "".join(pairs), "".join(pairs.values())


def latin(text: Column, first: Mapping[str, str]) -> Column:
    """The text in A to Z, with ``first`` applied before what every letter becomes otherwise."""
    found = F.upper(text)
    for letter in "AOU":  # letters whose two dots are a character of their own
        found = F.replace(found, F.lit(letter + "̈"), F.lit(unicodedata.normalize("NFC", letter + "̈")))
    for letter, said in {**SEVERAL, **first}.items():
        found = F.replace(found, F.lit(letter), F.lit(said))
    return F.translate(F.regexp_replace(found, r"\p{M}", ""), *_base_letters())


def name_forms(name: Column) -> Column:
    """The ways in which a printed name may stand in a zone: hyphens and commas as gaps, apostrophes and the rest left out."""
    gaps = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[-‐‑‒–,\s]+", " "), r"[^A-Z0-9 ]", ""), " +", " "))
    return F.array_distinct(F.array(*[gaps(latin(name, first)) for first in ({}, SINGLE, MARKED)]))


def names_agree(printed: Column, zone: Column, cut: Column) -> Column:
    """Whether a zone's name is the printed one, or, where the zone was too narrow, has beginnings of its words in their order."""

    def begins(form: Column) -> Column:
        own, other = F.split(zone, " "), F.split(form, " ")
        words = F.sequence(F.lit(0), F.size(own) - 1)
        return (F.size(own) <= F.size(other)) & F.forall(words, lambda i: F.get(other, i).startswith(F.get(own, i)))

    return F.exists(name_forms(printed), lambda form: (form == zone) | (cut & begins(form)))


def country_code(printed: Column, countries: Mapping[str, tuple[str, ...]] = COUNTRIES) -> Column:
    """The code of a printed nationality: one that is printed as such, or that of a known name; null for others."""
    known = F.create_map(*[F.lit(x) for code, names in countries.items() for name in names for x in (name, code)])
    plain = F.lower(F.trim(printed))
    return F.coalesce(known[plain], F.when(F.upper(plain).rlike("^(?:[A-Z]{3}|D)$"), F.upper(plain)))


_NUMERIC = r"^(\d{1,4})\s?([-/. ])\s?(\d{1,2})\s?\2\s?(\d{1,4})$"


def date_readings(printed: Column) -> Column:
    """All dates that a printed date can mean, earliest first; none if it is not understood or cannot exist.

    The year first, or a month by its name, has one reading; with slashes or hyphens between numbers
    the day or the month may come first; with dots or spaces the day does."""
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    months = F.create_map(*[F.lit(x) for k, names in enumerate(MONTHS) for name in names for x in (name, str(k + 1))])

    def of(text: Column) -> Column:
        part = lambda pattern, k: F.regexp_extract(text, pattern, k)
        a, sign, b, c = (part(_NUMERIC, k) for k in range(1, 5))
        year_last = (F.length(c) == 4) & (F.length(a) <= 2)
        worded = r"(?i)^(\d{1,2})[.\s-]*(?:de\s+)?(\p{L}{3,})[.]?(?:\s?/\s?\p{L}+[.]?)?[\s-]*(?:de\s+)?(\d{4})$"
        month_first = r"(?i)^(\p{L}{3,})[.]?\s+(\d{1,2}),?\s+(\d{4})$"
        number = lambda word: months[F.lower(word)]
        return F.array(
            F.when((F.length(a) == 4) & (F.length(c) <= 2), made(a, b, c)),
            F.when(year_last, made(c, b, a)),
            F.when(year_last & sign.isin("/", "-"), made(c, a, b)),
            F.when(text.rlike(worded), made(part(worded, 3), number(part(worded, 2)), part(worded, 1))),
            F.when(text.rlike(month_first), made(part(month_first, 3), number(part(month_first, 1)), part(month_first, 2))),
        )

    return F.array_sort(F.array_distinct(F.array_compact(let(F.trim(printed), of))))


def numeric_date(printed: Column) -> Column:
    """Whether it is a date in numbers, which cannot exist if it has no reading."""
    return F.trim(printed).rlike(_NUMERIC)
