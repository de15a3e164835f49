"""Keys of metrics and subjects, identities, page measures: Column expressions; string similarity and offset-bearing scans: Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a metric's key drops, words that it must keep, and corporate suffixes.
STOP = "the a an of for in on at to and as total value amount figure level rs inr usd million millions crore crores lakh billion mn cr bn per cent percent percentage pct".split()
KEEP = "adjusted unadjusted restated reported underlying normalised normalized pro forma gross net real nominal core headline average median per share diluted basic standalone consolidated service services".split()
SUFFIXES = "limited ltd pvt private inc plc corp corporation company co".split()
# The language of state changes, and the words before numbers that only structure a document.
STATE = (
    r"(?i)\b(appointed|resigned|retired|ceased|inducted|re-?designated|stepped\s+down|elevated|promoted|demised|vacated|incorporated|renamed|merged|acquired|divested|"
    r"is\s+(?:a|an|the)\s+\w+\s+director|independent\s+director|managing\s+director|chief\s+\w+\s+officer|registered\s+office|principal\s+place\s+of\s+business|listed\s+on|delisted|classified\s+as|designated\s+as)\b"
)
STRUCTURE = r"(?i)\b(note|notes|page|clause|section|schedule|para|paragraph|annexure|chapter|table|figure|chart|regulation|rule|item|sr\.?\s*no|s\.?\s*no)\b[\s.:]*$"
# What may stand before a scanned number, and after it (percentages; scales, masses and ratios as whole words).
SCAN_BEFORE = (r"[₹$€£]", r"\bRs\.?", r"\bUS\$", r"\bINR\b", r"\bUSD\b")
SCAN_PERCENT = ("%", r"per\s?cent", "percent", "bps?")
SCAN_UNITS = "cr crore crores lakh lakhs mn million bn billion tn trillion k thousand th tonne tonnes ton tons kg mt day days times x".split()
_DIGITS = r"\d{1,3}(?:[, ]\d{2,3})+(?:\.\d+)?|\d+\.\d+|\d{1,15}"
QUANTITY = rf"(?P<currency>{'|'.join(SCAN_BEFORE)})?\s*\(?(?P<number>{_DIGITS})\)?\s*(?P<post>{'|'.join(SCAN_PERCENT)}|\b(?:{'|'.join(SCAN_UNITS)})\b)?"


def metric_key(metric: Column) -> Column:
    """The words of a metric's name that tell it from others, lower-cased and in the singular."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(metric), r"\([^)]*\)", " "), r"[^a-z0-9_%\s]", " "), r"\s+", " "))
    kept = F.filter(F.split(plain, " "), lambda w: (w != "") & (w.isin(KEEP) | ~w.isin(STOP)))
    single = F.transform(kept, lambda w: F.when(~w.isin(KEEP) & (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.when(F.size(kept) > 0, F.array_join(single, " ")).otherwise(plain)


def subject_key(subject: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), r"\([^)]*\)", " ")
    low = F.regexp_replace(low, r"\b(" + "|".join(SUFFIXES) + r")\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9_\s]", " "), r"\s+", " "))


def rendered(qualifiers: Column) -> Column:
    """A map as text: k=v joined by commas in order of key."""
    entries = F.array_sort(F.map_entries(F.coalesce(qualifiers, F.create_map().cast("map<string,string>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def fact_id(locator: Column, metric: Column, said: Column, period: Column, qualifiers: Column) -> Column:
    """16 hex digits of where a fact stands and what it says; the metric as written."""
    parts = [F.coalesce(c, F.lit("")) for c in (locator, metric, said, period, rendered(qualifiers))]
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def relation_id(left: Column, right: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.least(left, right), F.greatest(left, right)).cast("binary")), 1, 16)


def locator(doc: Column, page: Column, start: Column, end: Column) -> Column:
    return F.concat(doc, F.lit("#p"), page.cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def has_state_language(text: Column) -> Column:
    return F.coalesce(text.rlike(STATE), F.lit(False))


def salience(before: Column, token: Column, line: Column, number: Column, currency: Column, post: Column) -> tuple[Column, Column]:
    """(salience, reason) of a scanned quantity: the first rule that fits. Any unit makes a measurement; a percent sign does not undo the form of a period or footnote."""
    said = lambda c: F.coalesce(c != "", F.lit(False))
    percent = F.lower(F.coalesce(post, F.lit(""))).rlike("^(%|per|bp)")
    named = said(currency) | (said(post) & ~percent)
    token, line = (F.btrim(c, F.lit(" \t\n\r")) for c in (token, line))
    rules = [
        (F.lower(F.substring(before, -3, 3)).rlike(r"(fy|cy|q|h)$") & ~named, "low", "period_token"),
        (token.startswith("(") & token.endswith(")") & ~number.contains(".") & (F.length(F.replace(number, F.lit(","), F.lit(""))) <= 2) & ~named, "low", "footnote_marker"),
        ((line == token) & (F.length(number) <= 4) & ~named & ~percent, "low", "standalone_number"),
        (named | percent | number.contains(",") | number.contains("."), "high", None),
        (F.length(number) <= 2, "low", "bare_small_integer"),
    ]
    level, reason = F.lit("high"), F.lit(None).cast("string")
    for rule, how, why in reversed(rules):
        level, reason = F.when(rule, F.lit(how)).otherwise(level), F.when(rule, F.lit(why).cast("string")).otherwise(reason)
    return level, reason


def _struct(ints: str, strings: str) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.IntegerType()) for c in ints.split()], *[T.StructField(c, T.StringType()) for c in strings.split()]])


@F.pandas_udf(T.ArrayType(_struct("start end", "text number currency post line before")))
def scan_spans(texts: pd.Series) -> pd.Series:
    """Every quantity of a text with its offsets; numbers after structural words of their line are passed over."""
    quantity, structure = re.compile(QUANTITY, re.I), re.compile(STRUCTURE)

    def scan(text: str | None) -> list[dict]:
        found = []
        for m in quantity.finditer(text or ""):
            token = m.group(0)
            start, end = m.start() + len(token) - len(token.lstrip()), m.end() - (len(token) - len(token.rstrip()))
            line_at = text.rfind("\n", 0, start) + 1
            line_end = text.find("\n", end)
            if structure.search(text[line_at:start]):
                continue
            line = text[line_at : line_end if line_end >= 0 else len(text)]
            found.append({"start": start, "end": end, "text": text[start:end], "number": m["number"], "currency": m["currency"] or "", "post": m["post"] or "", "line": line, "before": text[max(line_at, start - 3) : start]})
        return found

    return texts.map(scan)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


@F.pandas_udf(T.StringType())
def sorted_words(a: pd.Series) -> pd.Series:
    """The words in order, as token_sort_ratio compares them."""
    return a.map(lambda x: " ".join(sorted((x or "").split())))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 times the normalised insertion-deletion similarity of the sorted words."""
    return pd.Series([_ratio(" ".join(sorted((x or "").split())), " ".join(sorted((y or "").split()))) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best of: shared words against shared words with either's own, and the two wholes; 100 if one's words are all among the other's."""

    def one(x: str | None, y: str | None) -> float:
        p, q = set((x or "").split()), set((y or "").split())
        if not p or not q:
            return 0.0
        both, left, right = " ".join(sorted(p & q)), " ".join(sorted(p - q)), " ".join(sorted(q - p))
        if both and (not left or not right):
            return 100.0
        l, r = f"{both} {left}".strip(), f"{both} {right}".strip()
        return max(_ratio(l, r), _ratio(both, l) if both else 0.0, _ratio(both, r) if both else 0.0)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(_struct("start end", "how"))
def find_quote(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Where a quote stands in a text: as it is, else with any white space between its words, else with white space taken out of both."""

    def one(t: str | None, q: str | None) -> tuple[int | None, int | None, str | None]:
        t, q = t or "", (q or "").strip()
        if not q:
            return None, None, None
        if (at := t.find(q)) >= 0:
            return at, at + len(q), "exact"
        if m := re.search(r"\s+".join(map(re.escape, q.split())), t):
            return m.start(), m.end(), "spaced"
        bare = re.sub(r"\s+", "", q)
        places = [i for i, c in enumerate(t) if not c.isspace()]
        if len(bare) >= 4 and (at := "".join(t[i] for i in places).find(bare)) >= 0:
            return places[at], places[at + len(bare) - 1] + 1, "squeezed"
        return None, None, None

    return pd.DataFrame([one(t, q) for t, q in zip(text, quote, strict=True)], columns=["start", "end", "how"]).astype({"start": "Int32", "end": "Int32"})
