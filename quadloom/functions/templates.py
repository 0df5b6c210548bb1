"""URI templates (RFC 6570): parsed once on the driver, expanded as Column expressions, inverted as regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions.terms import PREFIXES, expand_iri

#: operator -> first, separator, named, text for an empty value, reserved characters allowed
_OPERATORS = {"": ("", ",", False, "", False), "+": ("", ",", False, "", True), "#": ("#", ",", False, "", True), ".": (".", ".", False, "", False),
              "/": ("/", "/", False, "", False), ";": (";", ";", True, "", False), "?": ("?", "&", True, "=", False), "&": ("&", "&", True, "=", False)}
_EXPRESSION = re.compile(r"\{([+#./;?&]?)([^{}]*)\}")
_VARIABLE = re.compile(r"^((?:[A-Za-z0-9_]|%[0-9A-Fa-f]{2})(?:\.?(?:[A-Za-z0-9_]|%[0-9A-Fa-f]{2}))*)(?::(\d{1,4})|(\*))?$")


@dataclass(frozen=True)
class Variable:
    name: str
    prefix: int | None = None
    explode: bool = False


@dataclass(frozen=True)
class Part:
    """Literal text, or an operator with its variables."""

    literal: str | None
    operator: str = ""
    variables: tuple[Variable, ...] = ()


def parse(template: str) -> list[Part]:
    out, at = [], 0
    for m in _EXPRESSION.finditer(template):
        if m.start() > at:
            out.append(Part(template[at : m.start()]))
        variables = []
        for v in m[2].split(","):
            x = _VARIABLE.match(v.strip())
            if not x:
                raise ValueError(f"not a URI template: {template}")
            variables.append(Variable(x[1], int(x[2]) if x[2] else None, bool(x[3])))
        out.append(Part(None, m[1], tuple(variables)))
        at = m.end()
    if at < len(template):
        out.append(Part(template[at:]))
    if any(p.literal is not None and ("{" in p.literal or "}" in p.literal) for p in out):
        raise ValueError(f"not a URI template: {template}")
    return out


def is_variable_name(name: str) -> bool:
    m = _VARIABLE.match(name)
    return bool(m) and m[1] == name


def variables(template: str) -> list[str]:
    return [v.name for p in parse(template) for v in p.variables]


def encode(value: Column, reserved: bool) -> Column:
    """Percent-encoding of all but unreserved (and, if asked, reserved) characters."""
    form, given = F.url_encode(value), value
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(a), F.lit(b))
    if reserved:
        for c in ":/?#[]@!$&'()*+,;=":
            form = F.replace(form, F.lit(f"%{ord(c):02X}"), F.lit(c))
        form = F.regexp_replace(form, "%25([0-9A-Fa-f]{2})", "%$1")  # what was encoded stays so
    return F.when(given.rlike("^[A-Za-z0-9._~-]*$"), given).otherwise(form)


def _item(lead: str, reserved: bool):
    return lambda x: F.concat(F.lit(lead), encode(x, reserved))


def expand(template: str, values: dict[str, Column], lists: frozenset[str] | set[str] = frozenset()) -> Column:
    """The template with column values; names in ``lists`` are arrays. Unknown variables are undefined."""
    pieces = []
    for p in parse(template):
        if p.literal is not None:
            pieces.append(F.lit(p.literal))
            continue
        first, sep, named, empty, reserved = _OPERATORS[p.operator]
        items = []
        for v in p.variables:
            if v.name not in values:
                continue
            col = values[v.name]
            if v.name in lists:
                own = F.filter(col, lambda x: x.isNotNull())
                joined = F.array_join(F.transform(own, _item(f"{v.name}=" if named and v.explode else "", reserved)), sep if v.explode else ",")
                text = F.when(F.size(own) > 0, joined if v.explode or not named else F.concat(F.lit(f"{v.name}="), joined))
            else:
                x = encode(F.substring(col, 1, v.prefix) if v.prefix else col, reserved)
                text = F.when(col == "", F.lit(v.name + empty)).otherwise(F.concat(F.lit(f"{v.name}="), x)) if named else x
            items.append(text)
        if not items:
            continue
        if len(items) == 1:
            pieces.append(F.coalesce(F.concat(F.lit(first), items[0]) if first else items[0], F.lit("")))
        else:
            body = F.concat_ws(sep, *items)
            pieces.append(F.when(F.coalesce(*items).isNotNull(), F.concat(F.lit(first), body)).otherwise(F.lit("")) if first else body)
    return F.concat(*pieces) if pieces else F.lit("")


def normalise_url(url: str) -> str:
    """Lower-case scheme and host, no default port, dot segments removed."""
    parts = urlsplit(url)
    if not parts.scheme or not parts.netloc:
        return url
    host = parts.netloc.lower()
    for scheme, port in (("http", ":80"), ("https", ":443")):
        if parts.scheme.lower() == scheme and host.endswith(port):
            host = host[: -len(port)]
    segments: list[str] = []
    for s in parts.path.split("/"):
        if s == "..":
            if len(segments) > 1:
                segments.pop()
        elif s != ".":
            segments.append(s)
    path = "/".join(segments) or "/"
    if parts.path.endswith(("/.", "/..")):
        path += "/"
    return urlunsplit((parts.scheme.lower(), host, path, parts.query, parts.fragment)) + ("#" if url.endswith("#") else "")


def is_absolute(text: str) -> bool:
    return bool(re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", text))


def beautify(iri: str) -> str:
    """International host names and decoded characters, as far as that keeps an IRI."""
    parts = urlsplit(iri)
    host = parts.netloc
    if "xn--" in host:
        try:
            host = host.encode("ascii").decode("idna")
        except UnicodeError:
            pass
    text = urlunsplit((parts.scheme, host, parts.path, parts.query, parts.fragment)) if host != parts.netloc else iri
    return re.sub(r"(?:%[89A-Fa-f][0-9A-Fa-f])+", lambda m: _decoded(m[0]), text)


def _decoded(text: str) -> str:
    try:
        return unquote(text, errors="strict")
    except UnicodeDecodeError:
        return text


def decode_column(iri: Column) -> Column:
    """Percent-encoded characters beyond ASCII back to themselves; what is ASCII is guarded by one more encoding."""
    guarded = F.replace(F.regexp_replace(iri, "%(?![89A-Fa-f][0-9A-Fa-f])", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(iri.rlike("%[89A-Fa-f]"), F.coalesce(F.try_url_decode(guarded), iri)).otherwise(iri)


def to_iri(template: str, table_url: str, values: dict[str, Column], lists: frozenset[str] | set[str] = frozenset(), pretty: bool = True) -> Column:
    """The expanded template as an IRI: known prefixes expand, relative results follow the table's URL."""
    parts = parse(template)
    head = parts[0].literal if parts and parts[0].literal is not None else ""
    if not variables(template):
        text = expand_iri(template)
        text = normalise_url(text) if is_absolute(text) else table_url + text
        return F.lit(beautify(text) if pretty else text)
    prefix = head.partition(":")[0]
    if prefix in PREFIXES and ":" in head and not head[len(prefix) + 1 :].startswith("//"):
        template = PREFIXES[prefix] + template[len(prefix) + 1 :]
    elif is_absolute(head):
        stem = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?=[/?#])", head)
        if stem:
            template = normalise_url(stem[0] + "/x")[:-2] + template[len(stem[0]) :]
    elif head or parts[0].operator == "#":
        template = table_url.replace("{", "%7B").replace("}", "%7D") + template
    else:  # the value decides
        text = expand(template, values, lists)
        from quadloom.functions.terms import expand_iri_column

        text = expand_iri_column(text)
        text = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(table_url), text))
        return decode_column(text) if pretty else text
    text = expand(template, values, lists)
    return decode_column(text) if pretty else text


def inverse(template: str, table_url: str, name: str) -> str | None:
    """A regular expression whose group 1 is the value of ``name`` in an IRI made by the template; None if it has none."""
    if name not in variables(template):
        return None
    text, found = "", False
    head = template.partition("{")[0]
    full = template if is_absolute(expand_iri(head)) or template.startswith("{+") else table_url + template
    for p in parse(expand_iri(full)):
        if p.literal is not None:
            text += re.escape(p.literal)
            continue
        first, sep, named, _, reserved = _OPERATORS[p.operator]
        text += re.escape(first)
        items = []
        for v in p.variables:
            body = ".*" if reserved else r"[^/?#]*?" if p.operator != "" or len(p.variables) > 1 else r"[^/?#]*"
            group = f"({body})" if v.name == name and not found else f"(?:{body})"
            found = found or v.name == name
            items.append((re.escape(v.name) + "=?" if named else "") + group)
        text += re.escape(sep).join(items)
    return f"^{text}$"


def like(template: str, table_url: str) -> tuple[str, str]:
    """A regular expression that the template's IRIs match, and their constant prefix (for pushdown)."""
    head = template.partition("{")[0]
    full = expand_iri(template) if is_absolute(expand_iri(head)) or template.startswith("{+") else table_url + template
    text = "".join(re.escape(p.literal) if p.literal is not None else re.escape(_OPERATORS[p.operator][0]) + ".*" for p in parse(full))
    return f"^{text}$", full.partition("{")[0] + (_OPERATORS[parse(full)[1].operator][0] if len(parse(full)) > 1 and parse(full)[0].literal is not None else "")
