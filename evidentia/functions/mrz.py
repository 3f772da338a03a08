"""Machine-readable zones: finding, slicing and checking lines, by the public standard ICAO Doc 9303."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the standard: weights of the check digit; the letters in the order of their values; for
#: each format the lines and their length, the letters that a zone may begin with, and slices (line,
#: start from 1, length). Visas have no digit of their own for the optional part and none for the whole;
#: the cards' optional parts have none of their own.
WEIGHTS = (7, 3, 1)
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = {"number": (2, 1, 9), "number_check": (2, 10, 1), "nationality": (2, 11, 3), "birth": (2, 14, 6), "birth_check": (2, 20, 1), "sex": (2, 21, 1), "expiry": (2, 22, 6), "expiry_check": (2, 28, 1), "issuer": (1, 3, 3)}
FORMATS = {
    "TD3": (2, 44, "P", _LOWER | {"optional": (2, 29, 14), "optional_check": (2, 43, 1), "composite_check": (2, 44, 1), "names": (1, 6, 39)}),
    "MRV-A": (2, 44, "V", _LOWER | {"optional": (2, 29, 16), "names": (1, 6, 39)}),
    "TD2": (2, 36, "ACIP", _LOWER | {"optional": (2, 29, 7), "composite_check": (2, 36, 1), "names": (1, 6, 31)}),
    "MRV-B": (2, 36, "V", _LOWER | {"optional": (2, 29, 8), "names": (1, 6, 31)}),
    "TD1": (3, 30, "ACI", {"number": (1, 6, 9), "number_check": (1, 15, 1), "optional": (1, 16, 15), "issuer": (1, 3, 3), "birth": (2, 1, 6), "birth_check": (2, 7, 1), "sex": (2, 8, 1), "expiry": (2, 9, 6), "expiry_check": (2, 15, 1), "nationality": (2, 16, 3), "composite_check": (2, 30, 1), "names": (3, 1, 30)}),
}
#: The slices that the digit of the whole covers.
COMPOSITE = {"TD3": [(2, 1, 10), (2, 14, 7), (2, 22, 22)], "TD2": [(2, 1, 10), (2, 14, 7), (2, 22, 14)], "TD1": [(1, 6, 25), (2, 1, 7), (2, 9, 7), (2, 19, 11)]}
#: Formats whose number may go on in the optional part.
LONG_NUMBERS = ("TD1", "TD2")
FIELDS = ("number", "number_check", "nationality", "birth", "birth_check", "sex", "expiry", "expiry_check", "issuer", "optional", "optional_check", "composite_check", "names")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, and once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def check_digit(field: Column) -> Column:
    """The check digit of a field, as text; null for null. Digits count as such, A to Z as 10 to 35, fillers 0."""
    weight = lambda i: F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (i % len(WEIGHTS) + 1).cast("int"))
    value = lambda c: F.when(c == "", 0).otherwise(F.greatest(F.position(c, F.lit(LETTERS)) - 1, F.lit(0)))
    products = F.transform(F.split(field, ""), lambda c, i: value(c) * weight(i))
    return (F.aggregate(products, F.lit(0), lambda a, x: a + x) % 10).cast("string")


def mrz_lines(text: Column) -> Column:
    """The lines of a text without the white space around them, blank ones left out; ends of any kind."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _format_at(lines: Column, i: Column) -> Column:
    """The format of a zone that begins at line ``i``: as many lines as it needs, each of its length, and its first letter."""
    shaped = lambda k, length: F.coalesce(F.get(lines, i + k).rlike(f"^[A-Z0-9<]{{{length}}}$"), F.lit(False))
    letter = F.substring(F.get(lines, i), 1, 1)
    found = F.lit(None).cast("string")
    for name, (count, length, first, _) in FORMATS.items():
        fits = letter.isin(*first)
        for k in range(count):
            fits &= shaped(k, length)
        found = F.when(fits, F.lit(name)).otherwise(found)
    return found


def zones(text: Column) -> Column:
    """All zones of a text in order, as structs of ``format`` and ``lines``; a line belongs to one zone at most."""
    counts = F.create_map(*[F.lit(x) for name, (count, *_) in FORMATS.items() for x in (name, count)])

    def of(lines: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(lines)), lambda i: F.struct(i.alias("at"), _format_at(lines, i).alias("format")))
        starts = F.filter(at, lambda s: s["format"].isNotNull())
        none = F.filter(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("format"))), lambda s: F.lit(False))
        kept = F.aggregate(starts, none, lambda held, s: F.when((F.size(held) == 0) | (s["at"] >= F.element_at(held, -1)["at"] + counts[F.element_at(held, -1)["format"]]), F.concat(held, F.array(s))).otherwise(held))
        return F.transform(kept, lambda s: F.struct(s["format"].alias("format"), F.slice(lines, s["at"] + 1, counts[s["format"]]).alias("lines")))

    return let(mrz_lines(text), of)


def _slices(lines: Column, format_: Column, parts: dict[str, list]) -> Column:
    """The texts that the format's slices cut from the lines, as an array; null slices stay null."""
    cut = "struct<line:int,start:int,length:int>"
    said = lambda part: F.lit(None).cast(cut) if part is None else F.struct(*[F.lit(x) for x in part]).cast(cut)
    layouts = F.create_map(*[c for name, own in parts.items() for c in (F.lit(name), F.array(*[said(p) for p in own]))])
    return F.transform(layouts[format_], lambda p: F.substring(F.get(lines, p["line"] - 1), p["start"], p["length"]))


def parse_mrz(cases: DataFrame, text: str = "text") -> DataFrame:
    """The cases with ``mrz_format``, the first zone's fields, and ``mrz_zones``: how many different zones the text has.

    Fields are null where there is no supported zone. A number longer than its nine places (cards only)
    goes on in the optional part: a filler stands for its digit, and the rest, the digit and a filler
    open that part. ``mrz_cut`` says that the names fill their places, but for one at most, so some may be
    missing."""
    layouts = {name: [layout.get(f) for f in FIELDS] for name, (_, _, _, layout) in FORMATS.items()}
    found = cases.withColumn("mrz_all", zones(F.col(text)))
    found = found.withColumn("mrz_zone", F.get("mrz_all", F.lit(0))).withColumn("mrz_zones", F.size(F.array_distinct("mrz_all"))).drop("mrz_all")
    lines, format_ = F.col("mrz_zone.lines"), F.col("mrz_zone.format")
    found = found.withColumn("mrz_values", _slices(lines, format_, layouts)).withColumn("mrz_whole", F.array_join(_slices(lines, format_, COMPOSITE), ""))
    value = lambda f: F.get("mrz_values", F.lit(FIELDS.index(f)))
    rest = F.when(format_.isin(*LONG_NUMBERS) & (value("number_check") == "<"), F.regexp_extract(value("optional"), "^([A-Z0-9]+)(?:<|$)", 1))
    found = found.withColumn("mrz_rest", F.when(F.length(rest) > 1, rest))
    long, names = F.col("mrz_rest").isNotNull(), F.split(value("names"), "<<")
    clean = lambda c: F.trim(F.translate(c, "<", " "))
    fields = {
        "mrz_format": format_,
        **{f"mrz_{f}": value(f) for f in FIELDS if f != "names"},
        "mrz_number": F.when(long, F.concat(value("number"), F.expr("left(mrz_rest, length(mrz_rest) - 1)"))).otherwise(value("number")),
        "mrz_number_check": F.when(long, F.right("mrz_rest", F.lit(1))).otherwise(value("number_check")),
        "mrz_optional": F.when(long, F.substring(value("optional"), F.length("mrz_rest") + 1, F.lit(15))).otherwise(value("optional")),
        "mrz_surname": clean(F.get(names, F.lit(0))),
        "mrz_given": clean(F.get(names, F.lit(1))),
        "mrz_cut": ~value("names").endswith("<<"),
    }
    return found.withColumns(fields).drop("mrz_values", "mrz_rest", "mrz_zone")


def mrz_checks(parsed: DataFrame) -> DataFrame:
    """Whether each check digit holds: number_ok, birth_ok, expiry_ok, optional_ok, composite_ok.

    Null without a zone, and where the format has no such digit. An empty optional field may carry a
    filler for its digit."""
    holds = lambda f: check_digit(F.col(f"mrz_{f}")) == F.col(f"mrz_{f}_check")
    empty = (F.col("mrz_optional_check") == "<") & F.col("mrz_optional").rlike("^<+$")
    return parsed.withColumns({"number_ok": holds("number"), "birth_ok": holds("birth"), "expiry_ok": holds("expiry"), "optional_ok": holds("optional") | empty, "composite_ok": check_digit(F.col("mrz_whole")) == F.col("mrz_composite_check")})


def digits_ok() -> Column:
    """Whether every digit that the format has holds; null without a zone."""
    has = lambda c: F.coalesce(F.col(c), F.lit(True))
    return F.when(F.col("mrz_format").isNotNull(), has("number_ok") & has("birth_ok") & has("expiry_ok") & has("optional_ok") & has("composite_ok"))


def mrz_date(value: Column, as_of: Column, future_years: int) -> Column:
    """A YYMMDD date. The century is the latest that puts it no more than ``future_years`` after ``as_of``."""
    this = lambda century: F.try_to_date(F.concat(F.lit(century), value), "yyyyMMdd")
    usable = F.when(value.rlike("^[0-9]{6}$"), F.lit(True))
    return F.when(usable, let(this("20"), lambda late: F.when(late.isNotNull() & (late <= F.add_months(as_of, 12 * future_years)), late).otherwise(this("19"))))
