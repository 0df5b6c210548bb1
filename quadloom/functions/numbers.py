"""Numbers: lexical checks per datatype, number patterns in both directions, canonical text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions.terms import INTEGERS

# The bounds of the XML Schema integer types.
EXTENTS = {
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-(2**7), 2**7 - 1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 2**8 - 1),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
}
SPECIAL = ["INF", "-INF", "NaN"]
PLAIN = {**{t: r"[+-]?[0-9]+" for t in INTEGERS}, "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
         **{t: r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?" for t in ("double", "float", "number")}}


@dataclass(frozen=True)
class Pattern:
    sign: str
    int_min: int
    primary: int
    secondary: int
    frac_min: int
    frac_max: int
    frac_group: int
    exp_min: int  # 0: no exponent
    exp_shown: int
    exp_sign: str
    before: str  # percent or permille before the digits
    after: str


def compile_pattern(pattern: str) -> Pattern:
    m = re.fullmatch(r"([+-]?)([%‰]?)([#0,]*)(?:\.([#0,]*))?(?:[eE]([+-]?)([#0]+))?([%‰]?)", pattern)
    if not m or not (m[3] or m[4]) or re.search("0[,]*#", m[3].replace(",", "")) or (m[4] and re.search("#,*0", m[4].replace(",", ""))) or (m[2] and m[7]):
        raise ValueError(f"not a number pattern: {pattern}")
    groups = m[3].split(",")
    frac = m[4] or ""
    return Pattern(m[1], m[3].count("0"), len(groups[-1]) if len(groups) > 1 else 0, len(groups[-2]) if len(groups) > 2 else len(groups[-1]) if len(groups) > 1 else 0,
                   frac.count("0"), len(frac.replace(",", "")), len(frac.split(",")[0]) if "," in frac else 0, len(m[6] or "") and max(1, m[6].count("0")), len(m[6] or ""), m[5] or "", m[2], m[7])


def pattern_regex(p: Pattern, decimal: str = ".", group: str = ",") -> str:
    """Anchored; what it matches is a number that the pattern can show."""
    d, g = re.escape(decimal), re.escape(group)
    sign = "[+-]" if p.sign == "+" else "-?" if not p.sign else "-"
    if p.primary:
        whole = rf"(?:\d{{1,{p.secondary}}}(?:{g}\d{{{p.secondary}}})*{g}\d{{{p.primary}}}|\d{{1,{p.primary}}})"
        if p.int_min > 1:
            whole = rf"(?=(?:{g}?\d){{{p.int_min}}})" + whole
        if not p.int_min:
            whole = f"(?:{whole})?"
    else:
        whole = rf"\d{{{p.int_min},}}"
    frac = ""
    if p.frac_max:
        if p.frac_group:
            body = rf"(?=(?:{g}?\d){{{max(p.frac_min, 1)},{p.frac_max}}}(?!{g}?\d))\d{{1,{p.frac_group}}}(?:(?<=\d{{{p.frac_group}}}){g}\d{{1,{p.frac_group}}})*"
        else:
            body = rf"\d{{{max(p.frac_min, 1)},{p.frac_max}}}"
        frac = f"{d}{body}" if p.frac_min else f"(?:{d}{body})?"
    exp = ""
    if p.exp_min:
        exp = "[eE]" + ("[+-]" if p.exp_sign == "+" else "-?") + rf"\d{{{p.exp_min},}}"
    return f"^{sign}{re.escape(p.before)}{whole}{frac}{exp}{re.escape(p.after)}$"


def plain(text: Column, decimal: str = ".", group: str | None = None) -> Column:
    """Without grouping and percent signs, with a full stop."""
    x = F.regexp_replace(text, "[%‰]", "")
    if group:
        x = F.replace(x, F.lit(group), F.lit(""))
    return F.replace(x, F.lit(decimal), F.lit(".")) if decimal != "." else x


def scale(text: Column) -> Column:
    return F.when(text.contains("%"), F.lit(100.0)).when(text.contains("‰"), F.lit(1000.0)).otherwise(F.lit(1.0))


def canonical(x: Column) -> Column:
    """A double's shortest text: plain between 1e-6 and 1e21, else with an exponent; -0 keeps its sign. No array function, so
    that it stays in generated code."""
    size, own = F.abs(x), x.cast("string")
    text = size.cast("string")  # the shortest digits, below 1e-3 and from 1e7 on with an exponent
    plain_ = lambda digits: F.regexp_replace(text.try_cast(f"decimal(38,{digits})").cast("string"), r"\.?0*$", "")
    exp = F.regexp_replace(F.regexp_replace(text, r"(?:\.0)?E-", "e-"), r"(?:\.0)?E", "e+")
    body = F.when((size >= 1e7) & (size < 1e21), plain_(17)).when((size >= 1e-6) & (size < 1e7), plain_(25)).otherwise(exp)
    sign = F.when(own.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    usual = ((size >= 1e-3) & (size < 1e7)) | (x == 0)  # the engine's own text, but for a trailing .0
    return F.when(usual, F.regexp_replace(own, r"\.0$", "")).when(F.isnan(x), F.lit("NaN")).when(size == float("inf"), F.concat(sign, F.lit("INF"))).otherwise(F.concat(sign, body))


#: A number of at most 15 digits without exponent: its digits are its canonical text but for zeros at the end.
SIMPLE = r"^(?!-?0\.000000)(?!-0(?:\.0*)?$)-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{0,15})?$"


def check(text: Column, base: str, pattern: str | None = None, decimal: str = ".", group: str | None = None) -> tuple[Column, Column, Column]:
    """(is valid, canonical text, double value) of a number's text."""
    if pattern or decimal != ".":
        return _checked(text, base, pattern, decimal, group)
    # most cells: nothing to be taken apart, and whole-stage code instead of array functions
    simple = text.rlike(SIMPLE) & (F.length(text) <= 16)
    ok, lex, value = _checked(text, base, None, decimal, group)
    dotted = text.contains(".")
    low, high = EXTENTS.get(base, (None, None))
    plain_ok = F.lit(True)
    if base in INTEGERS:
        plain_ok = ~dotted
        if low is not None and low > -(10**15):
            plain_ok = plain_ok & F.coalesce(text.try_cast("bigint") >= low, F.lit(False))
        if high is not None and high < 10**15:
            plain_ok = plain_ok & F.coalesce(text.try_cast("bigint") <= high, F.lit(False))
    short = F.when(dotted, F.regexp_replace(text, r"\.?0*$", "")).otherwise(text)
    return F.when(simple, plain_ok).otherwise(ok), F.when(simple, short).otherwise(lex), F.when(simple, text.try_cast("double")).otherwise(value)


def _checked(text: Column, base: str, pattern: str | None, decimal: str, group: str | None) -> tuple[Column, Column, Column]:
    """check() for any text."""
    special = text.isin(SPECIAL) if base in ("double", "float", "number") else F.lit(False)
    bare = plain(text, decimal, group or ("," if pattern else None))
    ok = bare.rlike(f"^(?:{PLAIN[base]})$") & text.rlike("^[%‰]?[^%‰]*$|^[^%‰]*[%‰]$")
    if pattern:
        ok = text.rlike(pattern_regex(compile_pattern(pattern), decimal, group or ",")) & bare.rlike(f"^(?:{PLAIN['double']})$")
    elif group:
        ok = ok & ~text.contains(group + group)
    low, high = EXTENTS.get(base, (None, None))
    exact = bare.try_cast("decimal(38,0)")
    if low is not None:
        ok = ok & (F.coalesce(exact >= F.lit(str(low)).cast("decimal(38,0)"), ~bare.startswith("-")))
    if high is not None:
        ok = ok & F.coalesce(exact <= F.lit(str(high)).cast("decimal(38,0)"), F.lit(False))
    value = bare.try_cast("double") / scale(text)
    value = F.when(special, F.when(text == "NaN", F.lit(float("nan"))).when(text == "INF", F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(value)
    if base in INTEGERS:
        # whole numbers beyond 2^53 keep their digits
        lex = F.when(F.abs(value) < 2.0**53, canonical(value)).otherwise(F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"))
    else:
        lex = canonical(value)
    return special | F.coalesce(ok, F.lit(False)), F.when(special, text).otherwise(lex), value


def show(x: Column, pattern: str, decimal: str = ".", group: str = ",") -> Column:
    """A double in a number pattern; halves round to even."""
    p = compile_pattern(pattern)
    factor = 100 if "%" in p.before + p.after else 1000 if p.before + p.after else 1
    v = F.abs(x) * factor
    exp = F.lit("")
    if p.exp_min:
        e = F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log10(v)).cast("int") - max(p.int_min, 1) + 1)
        v = v / F.pow(F.lit(10.0), e)
        exp = F.concat(F.lit("E"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+" if p.exp_sign == "+" else "")), F.lpad(F.abs(e).cast("string"), p.exp_shown, "0"))
    # from 1e20 on a double has no digits behind the point; beyond 38 digits there is its canonical text alone
    text = F.coalesce(F.bround(v.try_cast("decimal(38,18)"), p.frac_max).try_cast("decimal(38,18)").cast("string"), F.concat(v.try_cast("decimal(38,0)").cast("string"), F.lit(".0")))
    whole = F.regexp_replace(F.substring_index(text, ".", 1), "^0+(?=.)", "")
    whole = F.when(F.length(whole) < p.int_min, F.lpad(whole, p.int_min, "0")).otherwise(whole)
    if p.primary:
        tail = F.right(whole, F.lit(p.primary))
        head = F.when(F.length(whole) > p.primary, F.substring(whole, F.lit(1), F.length(whole) - p.primary)).otherwise(F.lit(""))
        head = F.regexp_replace(head, rf"(?<=\d)(?=(?:\d{{{p.secondary}}})+$)", re.escape(group).replace("\\", "\\\\") if group in "$\\" else group)
        whole = F.when(head == "", tail).otherwise(F.concat(head, F.lit(group), tail))
    frac = F.regexp_replace(F.substring(F.substring_index(text, ".", -1), 1, max(p.frac_max, 1)), "0+$", "") if p.frac_max else F.lit("")
    frac = F.when(F.length(frac) < p.frac_min, F.rpad(frac, p.frac_min, "0")).otherwise(frac) if p.frac_min else frac
    if p.frac_group:
        frac = F.regexp_replace(frac, rf"(\d{{{p.frac_group}}})(?=\d)", f"$1{group}")
    frac = F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit(decimal), frac))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit("+" if p.sign == "+" else ""))
    return F.coalesce(F.concat(sign, F.lit(p.before), whole, frac, exp, F.lit(p.after)), canonical(x))
