"""Written numbers, units and precision intervals, as Column expressions (no user functions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnitudes, currencies, masses, percent and ratio words.
MAGNITUDES = {"hundred": 1e2, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lac": 1e5, "lakhs": 1e5, "million": 1e6, "mn": 1e6, "mln": 1e6, "m": 1e6, "crore": 1e7, "cr": 1e7, "crores": 1e7, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "trn": 1e12}
CURRENCIES = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP"}
MASS = {"tonne": 1.0, "tonnes": 1.0, "ton": 1.0, "tons": 1.0, "mt": 1.0, "kg": 1e-3, "kilogram": 1e-3, "kilograms": 1e-3}
PERCENT = ("%", "per cent", "percent", "pc", "percentage", "ppt", "pp", "percentage point", "percentage points")
BASIS_POINTS = ("basis point", "basis points", "bps", "bp")
RATIOS = ("days", "day", "times", "x", "ratio", "index", "per share")
COUNTS = ("count", "number", "no", "nos", "units")
# What makes any unit a percentage that holds it.
PERCENT_INSIDE = ("per cent", "percent", "%")
APPROXIMATE_SLACK = 10.0
OVERLAP_SLACK = 1e-9

_GAP = r"[,\p{IsWhite_Space}]"
_NUMBER = r"([-−–+]?)(\d{1,3}(?:" + _GAP + r"\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)"


def parse_number(raw: Column) -> Column:
    """struct(value, ulp, negative, bound, sign_convention); null if the text holds no number. value is unsigned."""
    low = F.btrim(F.lower(raw), F.lit(" \t\n\r"))
    at_least = low.endswith("+") | low.rlike("[>≥]|over|more than|at least|in excess of|north of")
    at_most = low.rlike("[<≤]|under|less than|below|at most|up to")
    bound = F.when(at_least, "at_least").when(at_most, "at_most").when(low.rlike(r"[~≈]|about|approx|around|circa|c\."), "approximate").otherwise("exact")
    digits = F.regexp_replace(F.regexp_extract(raw, _NUMBER, 2), _GAP, "")
    bracketed = raw.rlike(r"\(\s*[\d.,]") & raw.contains(")")
    fraction = F.regexp_extract(digits, r"\.(\d+)$", 1)
    parsed = F.struct(
        digits.cast("double").alias("value"),
        F.when(fraction == "", F.lit(1.0)).otherwise(F.pow(F.lit(10.0), -F.length(fraction))).alias("ulp"),
        (bracketed | F.regexp_extract(raw, _NUMBER, 1).isin("-", "−", "–")).alias("negative"),
        bound.alias("bound"),
        F.when(bracketed, "parenthesised_negative").otherwise("plain").alias("sign_convention"),
    )
    return F.when(digits != "", parsed)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, words: tuple[str, ...], whole: bool) -> Column:
    """The first of words, in their order, that the text holds (as a whole word, if it is made of letters)."""
    result = F.lit(None).cast("string")
    for w in reversed(words):
        there = text.rlike(r"(^|[^a-z])" + re.escape(w) + r"($|[^a-z])") if whole and w[0].isalpha() else text.contains(w)
        result = F.when(there, F.lit(w)).otherwise(result)
    return result


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"^\.+|\.+$", ""))


def normalise_unit(unit: Column, magnitude: Column | None = None, compat: bool = False) -> Column:
    """struct(canonical, family, factor): value * factor is in the canonical unit. A unit that is not known is its own, scaled by its magnitude word.

    compat: basis points count as percent, and currencies and ratio words are found inside other words.
    """
    words = r"\b(" + "|".join(sorted(MAGNITUDES, key=lambda w: (-len(w), w))) + r")\b"
    made = lambda canonical, family, factor: F.struct(canonical.alias("canonical"), family.alias("family"), factor.cast("double").alias("factor"))

    def known(x: Column) -> Column:
        rest, factor = x["rest"], F.coalesce(F.try_element_at(_table(MAGNITUDES), x["word"]), F.lit(1.0))
        of_all = F.lit(False)
        for w in PERCENT_INSIDE:
            of_all = of_all | rest.contains(w)
        ratio = F.when(rest == "", "ratio").otherwise(rest)
        currency = F.try_element_at(_table(CURRENCIES), _found(rest, tuple(CURRENCIES), not compat))
        mass = _found(rest, tuple(MASS), True)
        return (
            F.when(rest.isin(*BASIS_POINTS), made(F.lit("percent"), F.lit("percent"), F.lit(1.0 if compat else 0.01)))
            .when(rest.isin(*PERCENT) | of_all, made(F.lit("percent"), F.lit("percent"), F.lit(1.0)))
            .when(_found(rest, RATIOS, not compat).isNotNull(), made(ratio, F.concat(F.lit("ratio:"), ratio), F.lit(1.0)))
            .when(currency.isNotNull(), made(F.concat(currency, F.lit("_million")), F.concat(F.lit("currency:"), currency), factor / 1e6))
            .when(mass.isNotNull(), made(F.lit("tonne"), F.lit("mass"), F.try_element_at(_table(MASS), mass) * factor))
            .when((rest == "") | rest.isin(*COUNTS), made(F.lit("count"), F.lit("count"), factor))
            .otherwise(made(rest, F.concat(F.lit("other:"), rest), factor))
        )

    def cut(x: Column) -> Column:
        explicit = x["given"].isin(*MAGNITUDES)
        inside = F.array_max(F.transform(F.regexp_extract_all(x["text"], F.lit(words), 1), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        word = F.when(explicit, x["given"]).otherwise(inside)
        rest = F.when(explicit | word.isNull(), x["text"]).otherwise(F.trim(F.regexp_replace(x["text"], F.concat(F.lit(r"\b"), F.coalesce(word, F.lit("")), F.lit(r"\b")), F.lit(""))))
        return _let(F.struct(word.alias("word"), F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("rest")), known)

    return _let(F.struct(_plain(unit).alias("text"), _plain(magnitude if magnitude is not None else F.lit("")).alias("given")), cut)


def build_interval(parsed: Column, unit: Column, rel_slack: float = 0.0) -> Column:
    """struct(canonical_value, lo, hi): what a number written to its precision can mean, in canonical units."""
    factor = unit.getField("factor")
    value = F.when(parsed.getField("negative"), -parsed.getField("value")).otherwise(parsed.getField("value")) * factor
    half = parsed.getField("ulp") * 0.5 * factor
    half = F.when(parsed.getField("bound") == "approximate", half * APPROXIMATE_SLACK).otherwise(half) + F.abs(value) * rel_slack
    lo = F.when(parsed.getField("bound") == "at_most", F.lit(float("-inf"))).otherwise(value - half)
    hi = F.when(parsed.getField("bound") == "at_least", F.lit(float("inf"))).otherwise(value + half)
    return F.struct(value.alias("canonical_value"), lo.alias("lo"), hi.alias("hi"))


def intervals_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.least(hi1, hi2) - F.greatest(lo1, lo2) > OVERLAP_SLACK


def relative_gap(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) / F.when(top == 0, 1.0).otherwise(top))


def separation(v1: Column, lo1: Column, hi1: Column, v2: Column, lo2: Column, hi2: Column) -> Column:
    """The values' distance in widths of the coarser interval; null for open intervals."""
    width = F.greatest(hi1 - lo1, hi2 - lo2)
    return F.when((width < float("inf")) & (width > 0), F.abs(v1 - v2) / F.when(width > 0, width).otherwise(1.0))


def unit_family(canonical: Column) -> Column:
    return F.when(canonical.endswith("_million"), F.concat(F.lit("currency:"), F.regexp_extract(canonical, "^(.*)_million$", 1))).otherwise(canonical)


def display(value: Column, decimals: Column | None = None) -> Column:
    """A number for readers: with so many decimals, else none from 1000 on, up to two from 1 on, and four significant digits below."""
    size = F.abs(value)
    if decimals is None:
        below = F.lit(4) - F.ceil(F.log10(F.when((size > 0) & (size < 1), size).otherwise(1.0)))
        places = F.when(size >= 1000, 0).when(size >= 1, 2).otherwise(below).cast("int")
        shown = F.regexp_replace(F.call_function("format_number", value, places), r"(\.\d*[1-9])0+$|\.0*$", "$1")
    else:
        shown = F.call_function("format_number", value, decimals)
    return F.when(value.isNull(), "?").when(size == float("inf"), "unbounded").otherwise(shown)


def display_interval(lo: Column, hi: Column) -> Column:
    """Both ends with enough decimals to tell them apart, six at most."""
    width = F.abs(hi - lo)
    decimals = F.least(F.lit(6), F.greatest(F.lit(0), F.ceil(-F.log10(F.when(width > 0, width).otherwise(1.0))) + 1)).cast("int")
    open_ = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    both = lambda a, b: F.concat(a, F.lit("–"), b)
    return F.when(lo.isNull() | hi.isNull(), "?").when(open_, both(display(lo), display(hi))).when(width == 0, display(lo)).otherwise(both(display(lo, decimals), display(hi, decimals)))


def display_separation(separation: Column) -> Column:
    """How far apart two figures are, in rounding steps of the coarser."""
    return F.when(separation.isNull(), "").when(separation > 100, " (far beyond any rounding)").otherwise(F.concat(F.lit(" ("), F.format_string("%.1f", separation), F.lit(" rounding steps of the coarser)")))
