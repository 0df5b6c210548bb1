"""Cell text to checked lexical value and back, by datatype. All results are Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions import dates, numbers
from quadloom.functions.terms import BINARY, DATATYPE_URI, DATES, DURATIONS, MARKUP, NUMERIC, PARTIAL_DATES, expand_iri


@dataclass(frozen=True)
class Datatype:
    base: str = "string"
    id: str | None = None
    format: Any = None  # text, or {pattern, decimalChar, groupChar}
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    bounds: dict[str, str] = field(default_factory=dict, hash=False)  # minInclusive, maxInclusive, minExclusive, maxExclusive

    @property
    def uri(self) -> str:
        return expand_iri(self.id) if self.id else DATATYPE_URI[self.base]

    @property
    def number_format(self) -> tuple[str | None, str, str | None]:
        if isinstance(self.format, dict):
            return self.format.get("pattern"), self.format.get("decimalChar") or ".", self.format.get("groupChar")
        return self.format, ".", None


def white_space(text: Column, base: str) -> Column:
    """Collapses and trims, but for string, json, xml, html and anyAtomicType; normalizedString keeps its length."""
    if base in ("string", *MARKUP, "anyAtomicType", "any"):
        return text
    if base == "normalizedString":
        return F.regexp_replace(text, r"[\t\r\n]", " ")
    return F.when(text.rlike(r"\s"), F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(text)


def size(text: Column, base: str) -> Column:
    if base == "hexBinary":
        return (F.length(text) / 2).cast("int")
    if base in ("base64Binary", "binary"):
        return F.floor(F.length(F.regexp_replace(text, r"[=\s]", "")) * 3 / 4).cast("int")
    # UTF-16 units: characters beyond the first plane count twice
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def _bounded(ok: Column, value: Column, bounds: dict[str, str], literal) -> Column:
    for k, v in bounds.items():
        b = literal(str(v))
        ok = ok & F.coalesce({"minInclusive": value >= b, "maxInclusive": value <= b, "minExclusive": value > b, "maxExclusive": value < b}[k], F.lit(False))
    return ok


def check(text: Column, dt: Datatype) -> tuple[Column, Column]:
    """(is valid, canonical text); an invalid value keeps its text."""
    base = dt.base
    ok, lex = F.lit(True), text
    fmt = dt.format if isinstance(dt.format, str) else None
    if base in NUMERIC:
        pattern, decimal, group = dt.number_format
        ok, lex, value = numbers.check(text, base, pattern, decimal, group)
        inside = _bounded(F.lit(True), value, dt.bounds, lambda v: F.lit({"INF": "Infinity", "-INF": "-Infinity"}.get(v, v)).cast("double"))
        ok = ok & (inside | F.isnan(value) if dt.bounds else F.lit(True))
    elif base == "boolean":
        yes, no = (fmt.split("|") + [""])[:2] if fmt and "|" in fmt else (None, None)
        if yes is not None:
            ok, lex = text.isin(yes, no), F.when(text == yes, F.lit("true")).when(text == no, F.lit("false"))
        else:
            ok, lex = text.isin("true", "1", "false", "0"), F.when(text.isin("true", "1"), F.lit("true")).otherwise(F.lit("false"))
    elif base in DATES:
        ok, lex = dates.check(text, base, fmt)
        if dt.bounds:
            def bound(v: str) -> Column:
                return dates.instant(dates.check(F.lit(v), base)[1], base)

            ok = ok & _bounded(F.lit(True), dates.instant(lex, base), dt.bounds, bound)
    elif base in PARTIAL_DATES:
        ok = text.rlike(f"^(?:{dates.PARTIAL[base]})$")
    elif base in DURATIONS:
        ok = text.rlike(f"^(?:{dates.DURATION[base]})$")
        if fmt:
            ok = ok & text.rlike(fmt)
        if dt.bounds:
            ok = ok & _bounded(F.lit(True), dates.duration_seconds(text), dt.bounds, lambda v: dates.duration_seconds(F.lit(v)))
    else:
        if base == "hexBinary":
            ok = text.rlike("^(?:[0-9a-fA-F]{2})*$")
        elif base in BINARY:
            ok = text.rlike(r"^(?:[A-Za-z0-9+/]\s?){0,}={0,2}$")
        if fmt and base not in MARKUP:
            ok = ok & text.rlike(fmt)
    for limit, test in ((dt.length, lambda n, x: n == x), (dt.min_length, lambda n, x: n >= x), (dt.max_length, lambda n, x: n <= x)):
        if limit is not None:
            ok = ok & test(size(text, base), limit)
    plain = _plain(text, dt)
    if plain is None:
        return ok, F.when(ok, lex).otherwise(text)
    return F.when(plain, F.lit(True)).otherwise(ok), F.when(plain, text).when(ok, lex).otherwise(text)


def _plain(text: Column, dt: Datatype) -> Column | None:
    """Whether the text is what the engine itself writes for a whole number of at most 15 places or a day: valid and canonical
    without a regular expression. None where a format, facets or the datatype's extent must be looked at."""
    if dt.format or dt.bounds or any(n is not None for n in (dt.length, dt.min_length, dt.max_length)):
        return None
    if dt.base == "date":
        return (F.length(text) == 10) & (text.try_cast("date").cast("string") == text)
    low, high = numbers.EXTENTS.get(dt.base, (None, None))
    if dt.base in numbers.INTEGERS and (low is None or low <= -(10**15)) and (high is None or high >= 10**15):
        return (F.length(text) <= 15) & (text.try_cast("bigint").cast("string") == text)
    return None


def render(text: Column, dt: Datatype) -> Column:
    """A canonical value in the datatype's format; what cannot be shown stays as it is."""
    base = dt.base
    fmt = dt.format if isinstance(dt.format, str) else None
    if base == "boolean" and fmt and "|" in fmt:
        yes, no = fmt.split("|")[:2]
        return F.when(text.isin("true", "1"), F.lit(yes)).when(text.isin("false", "0"), F.lit(no)).otherwise(text)
    if base in NUMERIC:
        pattern, decimal, group = dt.number_format
        value = text.try_cast("double")
        if pattern:
            return F.when(value.isNull() | text.isin(numbers.SPECIAL), text).otherwise(numbers.show(value, pattern, decimal, group or ","))
        return F.replace(text, F.lit("."), F.lit(decimal)) if decimal != "." else text
    if base in DATES and fmt:
        ok, lex = dates.check(text, base)
        return F.when(ok, dates.show(lex, base, fmt)).otherwise(text)
    return text


def satisfies(text: Column, dt: Datatype) -> Column:
    """Whether a term's text meets the datatype's facets (formats of the text itself apart): the filters of table extraction."""
    base = dt.base
    ok = F.lit(True)
    if base in NUMERIC and dt.bounds:
        value = F.when(text == "INF", F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).otherwise(text.try_cast("double"))
        inside = _bounded(value.isNotNull(), value, dt.bounds, lambda v: F.lit(v).cast("double"))
        ok = inside | (text == "NaN") if base in ("double", "float", "number") else inside
    elif base in DATES and dt.bounds:
        ok = _bounded(F.lit(True), dates.instant(dates.check(text, base)[1], base), dt.bounds, lambda v: dates.instant(dates.check(F.lit(v), base)[1], base))
    elif base in DURATIONS and dt.bounds:
        ok = _bounded(F.lit(True), dates.duration_seconds(text), dt.bounds, lambda v: dates.duration_seconds(F.lit(v)))
    if base not in (*NUMERIC, *DATES, *DURATIONS, "boolean", *MARKUP) and isinstance(dt.format, str):
        ok = ok & text.rlike(dt.format)
    if base not in NUMERIC:
        n = F.length(text)
        for limit, test in ((dt.length, n == (dt.length or 0)), (dt.min_length, n >= (dt.min_length or 0)), (dt.max_length, n <= (dt.max_length or 0))):
            if limit is not None:
                ok = ok & test
    return F.coalesce(ok, F.lit(False))


def displayable(text: Column, dt: Datatype) -> Column:
    """Whether a term's text can be shown in the datatype's format; what cannot be is shown as it is."""
    base = dt.base
    fmt = dt.format if isinstance(dt.format, str) else None
    ok = F.lit(True)
    if base == "boolean":
        ok = text.isin("true", "1", "false", "0")
    elif base in NUMERIC:
        ok = text.isin(numbers.SPECIAL) | text.try_cast("double").isNotNull()
    elif base in DATES:
        ok = dates.check(text, base)[0]
    elif base in PARTIAL_DATES:
        ok = text.rlike(f"^(?:{dates.PARTIAL[base]})$")
    elif base in DURATIONS:
        ok = text.rlike(f"^(?:{dates.DURATION[base]})$")
        if fmt:
            ok = ok & text.rlike(fmt)
    return F.coalesce(ok, F.lit(False))
