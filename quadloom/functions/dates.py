"""Dates, times and durations as text: patterns in both directions, canonical forms, comparable values."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = r"(?:Z|[+-]\d{2}(?::?\d{2})?)"
_FIELDS = {"y": r"-?\d{4,}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{2}", "s": r"\d{2}", "S": r"\d+", "X": ZONE}
_TOKEN = re.compile(r"yyyy|MM|M|dd|d|HH|mm|ss|S+|X{1,3}|x{1,3}|'[^']*'|.")
DEFAULT = {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "dateTime": "yyyy-MM-ddTHH:mm:ss", "datetime": "yyyy-MM-ddTHH:mm:ss", "dateTimeStamp": "yyyy-MM-ddTHH:mm:ss"}
# The lexical forms of the XML Schema types.
PARTIAL = {"gDay": rf"---\d{{2}}{ZONE}?", "gMonth": rf"--\d{{2}}{ZONE}?", "gMonthDay": rf"--\d{{2}}-\d{{2}}{ZONE}?", "gYear": rf"-?\d{{4,}}{ZONE}?", "gYearMonth": rf"-?\d{{4,}}-\d{{2}}{ZONE}?"}
DURATION = {"duration": r"-?P(?=.)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?",
            "dayTimeDuration": r"-?P(?=.)(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?", "yearMonthDuration": r"-?P(?=.)(?:\d+Y)?(?:\d+M)?"}


def tokens(pattern: str) -> list[tuple[str, str]]:
    """(field, token); the field of literal text is ''."""
    out = []
    for t in _TOKEN.findall(pattern):
        c = t[0]
        out.append((c.replace("x", "X"), t) if c in "yMdHmsSXx" and (c != "y" or t == "yyyy") else ("", t.strip("'") if len(t) > 1 else t))
    return out


def pattern_regex(pattern: str | None, base: str) -> tuple[str, list[str]]:
    """Anchored, and the field of each group. Without a zone in the pattern none is allowed, without a pattern one is."""
    text, fields = "", []
    for field, t in tokens(pattern or DEFAULT[base]):
        if not field:
            text += re.escape(t)
            continue
        body = _FIELDS[field]
        if t in ("MM", "dd", "HH"):
            body = r"\d{2}"
        if field == "S":
            body = rf"\d{{1,{len(t)}}}"
            if text.endswith(r"\."):
                text = text[:-2] + rf"(?:\.({body}))?"
                fields.append(field)
                continue
        text += f"({body})"
        fields.append(field)
    if not pattern:
        if base != "date":
            text += r"(?:\.(\d+))?"
            fields.append("S")
        text += f"({ZONE})" + ("" if base == "dateTimeStamp" else "?")
        fields.append("X")
    return f"^{text}$", fields


def _zone(z: Column) -> Column:
    return F.when(z.rlike(r"^[+-]\d{2}$"), F.concat(z, F.lit(":00"))).when(z.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2))).otherwise(z)


def check(text: Column, base: str, pattern: str | None = None) -> tuple[Column, Column]:
    """(is valid, canonical text)."""
    regex, fields = pattern_regex(pattern, base)
    got = {f: F.regexp_extract(text, regex, i + 1) for i, f in enumerate(fields)}
    two = lambda k, d: F.lpad(got[k], 2, "0") if k in got else F.lit(d)
    day = F.concat(got.get("y", F.lit("2000")), F.lit("-"), two("M", "01"), F.lit("-"), two("d", "01"))
    frac = F.regexp_replace(got["S"], "0+$", "") if "S" in got else F.lit("")
    clock = F.concat(two("H", "00"), F.lit(":"), two("m", "00"), F.lit(":"), two("s", "00"), F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    zone = _zone(got["X"]) if "X" in got else F.lit("")
    ok = text.rlike(regex)
    if base != "time":
        ok = ok & day.try_cast("date").isNotNull()
    if base != "date":
        inside = (two("H", "00") <= "23") & (two("m", "00") <= "59") & (two("s", "00") <= "59")
        ok = ok & (inside | (clock == "24:00:00"))
    body = day if base == "date" else clock if base == "time" else F.concat(day, F.lit("T"), clock)
    return F.coalesce(ok, F.lit(False)), F.concat(body, zone)


def instant(canonical: Column, base: str) -> Column:
    """Comparable value: microseconds with the offset taken off; times fall on 2000-01-01."""
    bare = F.regexp_replace(canonical, ZONE + "$", "") if base != "date" else F.regexp_replace(canonical, r"(?<=\d{4}-\d{2}-\d{2})" + ZONE + "$", "")
    zone = F.regexp_extract(canonical, ("(?<=:[0-9]{2}|[.][0-9]{1,9})" if base != "date" else r"(?<=\d{4}-\d{2}-\d{2})") + f"({ZONE})$", 1)
    stamp = F.concat(F.lit("2000-01-01T"), bare) if base == "time" else bare
    offset = F.when(zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(zone, 5, 2).try_cast("int"), F.lit(0)))).otherwise(F.lit(0))
    return F.unix_micros(F.concat(stamp, F.lit("Z")).try_cast("timestamp") if base != "date" else F.concat(stamp, F.lit("T00:00:00Z")).try_cast("timestamp")) - offset.cast("bigint") * 60_000_000


def show(canonical: Column, base: str, pattern: str) -> Column:
    """A canonical date or time in a pattern, in its own zone."""
    regex, fields = pattern_regex(None, base)
    got = {f: F.regexp_extract(canonical, regex, i + 1) for i, f in enumerate(fields)}
    pieces = []
    for field, t in tokens(pattern):
        if not field:
            pieces.append(F.lit(t))
            continue
        x = got.get(field, F.lit(""))
        if field in "MdH" and len(t) == 1:
            x = F.regexp_replace(x, "^0", "")
        elif field == "S":
            x = F.rpad(F.substring(x, 1, len(t)), len(t), "0")
        elif field == "X":
            x = F.when(x == "Z", F.lit("Z" if t[0] == "X" else "+00" if t == "x" else "+0000" if t == "xx" else "+00:00")).when(x == "", x).otherwise(
                F.regexp_replace(_zone(x), ":00$", "") if len(t) == 1 else F.replace(_zone(x), F.lit(":"), F.lit("")) if len(t) == 2 else _zone(x))
        pieces.append(x)
    return F.concat(*pieces)


def duration_seconds(text: Column) -> Column:
    """A month is 30.4375 days, a year 365.25."""
    date, time = F.substring_index(text, "T", 1), F.when(text.contains("T"), F.substring_index(text, "T", -1)).otherwise(F.lit(""))
    part = lambda x, u: F.coalesce(F.regexp_extract(x, rf"(\d+(?:\.\d+)?){u}", 1).try_cast("double"), F.lit(0.0))
    total = (part(date, "Y") * 365.25 + part(date, "M") * 30.4375 + part(date, "D")) * 86400 + part(time, "H") * 3600 + part(time, "M") * 60 + part(time, "S")
    return F.when(text.startswith("-"), -total).otherwise(total)


def seconds_of_duration(text: str) -> float:
    """A descriptor's duration in the measure of duration_seconds()."""
    m = re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m or not any(m.groups()[1:]):
        raise ValueError(text)
    years, months, days, hours, minutes, seconds = (float(x or 0) for x in m.groups()[1:])
    total = (years * 365.25 + months * 30.4375 + days) * 86400 + hours * 3600 + minutes * 60 + seconds
    return -total if m[1] else total


def seconds_of_date(text: str) -> float:
    """A descriptor's date or time as seconds; without a zone it counts as UTC."""
    clock = re.fullmatch(r"(\d\d:\d\d:\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?", text)
    day = re.fullmatch(r"(\d{4}-\d\d-\d\d)(Z|[+-]\d\d:\d\d)?", text)
    if clock:
        text = "2000-01-01T" + text
    elif day:
        text = day[1] + "T00:00:00" + (day[2] or "")
    found = datetime.fromisoformat(text.replace("T24:00:00", "T00:00:00"))
    return (found if found.tzinfo else found.replace(tzinfo=UTC)).timestamp() + (86400 if "T24:" in text else 0)
