"""RDF documents as quad DataFrames. N-Triples and N-Quads are read natively, line by line; Turtle, TriG, JSON-LD and
RDF/XML are parsed whole, one file to a task (their syntax has no line borders)."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from decimal import Decimal
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime
from quadloom.functions.terms import PREFIXES, QUAD, QUAD_COLUMNS, RDF, XSD

Row = tuple[str, str, str, str, str, str | None, str | None, str | None]

_IRI, _BNODE = r"<([^<>\"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>", r"_:[^\s<>\"]+"
_LITERAL = r"\"(?:[^\"\\\n\r]|\\.)*\"(?:\^\^" + _IRI.replace("(", "(?:") + r"|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?"
LINE = (rf"^\s*({_IRI.replace('(', '(?:')}|{_BNODE})\s*({_IRI.replace('(', '(?:')})\s*({_IRI.replace('(', '(?:')}|{_BNODE}|{_LITERAL})\s*({_IRI.replace('(', '(?:')}|{_BNODE})?\s*\.\s*(?:#.*)?$")


def _unescape(text: Column) -> Column:
    """Escapes of N-Triples; the pieces are taken one by one, so that an escaped backslash does not start another."""
    pieces = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def one(p: Column) -> Column:
        code = F.when(p.rlike(r"^\\[uU]"), F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32"))
        simple = F.translate(F.substring(p, 2, 1), "tbnrf", "\t\b\n\r\f")
        return F.when(~p.startswith("\\"), p).otherwise(F.coalesce(code, simple))

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _node(t: Column) -> Column:
    return F.when(t.startswith("<"), _unescape(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def _kind(t: Column) -> Column:
    return F.when(t.startswith("<"), F.lit("iri")).when(t.startswith("_:"), F.lit("bnode")).otherwise(F.lit("literal"))


def parse_nquads(lines: DataFrame, col: str = "value") -> DataFrame:
    """Quads of text lines; comments and blank lines are skipped, malformed lines fail."""
    line = F.col(col)
    rows = lines.where(~line.rlike(r"^\s*(?:#.*)?$")).select(
        F.when(line.rlike(LINE), line).otherwise(F.raise_error(F.concat(F.lit("not an N-Quads line: "), line))).alias("l"))
    t = rows.select(*[F.regexp_extract("l", LINE, i).alias(f"f{i}") for i in (1, 2, 3, 4)])
    s, p, o, g = (F.col(f"f{i}") for i in (1, 2, 3, 4))
    body = F.regexp_extract(o, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    dt, lang = F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)
    literal = o.startswith('"')
    return t.select(_kind(s).alias("s_kind"), _node(s).alias("s"), _node(p).alias("p"), _kind(o).alias("o_kind"), F.when(literal, _unescape(body)).otherwise(_node(o)).alias("o"),
                    F.when(literal, F.when(lang != "", F.lit(RDF + "langString")).when(dt != "", _unescape(dt)).otherwise(F.lit(XSD + "string"))).alias("o_dt"), F.when(literal & (lang != ""), lang).alias("o_lang"), F.when(g != "", _node(g)).alias("g"))


class Turtle:
    """Turtle and TriG; permissive: N-Triples and N-Quads are read too."""

    TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)|(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')"""
                       r"""|(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<bnode>_:[^\s<>"'()\[\]{};,.]+(?:\.[^\s<>"'()\[\]{};,.]+)*)"""
                       r"""|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))(?=[\s;,.)\]}#]|$)|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)"""
                       r"""|(?P<word>[A-Za-z]+)|(?P<punct>[.;,()\[\]{}])""", re.S)

    def __init__(self, text: str, base: str = "", label: str = "b"):
        self.base, self.label, self.prefixes, self.rows = base, label, {}, []
        self.count, self.graph, self.named = 0, None, {}
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = self.TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"cannot parse at: {text[at : at + 40]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def expect(self, text: str) -> None:
        if self.next()[1] != text:
            raise ValueError(f"{text} was expected near {self.tokens[max(0, self.at - 4) : self.at]}")

    def fresh(self) -> str:
        self.count += 1
        return f"_:{self.label}{self.count}"

    @staticmethod
    def unescape(text: str) -> str:
        table = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else table.get(m[1], m[1]), text, flags=re.S)

    def iri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            own = self.unescape(text[1:-1])
            if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", own) or not self.base:
                return own
            return urljoin(self.base, own) + ("#" if own.endswith("#") else "")  # urljoin drops an empty fragment
        if kind == "name":
            head, _, rest = text.partition(":")
            if head not in self.prefixes and head not in PREFIXES:
                raise ValueError(f"unknown prefix {head}")
            return self.prefixes.get(head, PREFIXES.get(head, "")) + re.sub(r"\\(.)", r"\1", rest)
        raise ValueError(f"an IRI was expected, not {text}")

    def add(self, s: str, p: str, o: tuple[str, str, str | None, str | None]) -> None:
        self.rows.append(("bnode" if s.startswith("_:") else "iri", s, p, *o, self.graph))

    def node(self) -> str:
        kind, text = self.peek()
        if kind == "bnode":
            self.next()
            return self.named.setdefault(text, f"_:{self.label}x{text[2:]}")
        if text == "[":
            self.next()
            s = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(s)
            self.expect("]")
            return s
        if text == "(":
            self.next()
            items = []
            while self.peek()[1] != ")":
                items.append(self.object())
            self.next()
            rest = RDF + "nil"
            for o in reversed(items):
                n = self.fresh()
                self.add(n, RDF + "first", o)
                self.add(n, RDF + "rest", ("bnode" if rest.startswith("_:") else "iri", rest, None, None))
                rest = n
            return rest
        return self.iri(self.next())

    def object(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.peek()
        if kind in ("str", "long"):
            self.next()
            value = self.unescape(text[3:-3] if kind == "long" else text[1:-1])
            k, t = self.peek()
            if k == "at":
                self.next()
                return "literal", value, RDF + "langString", t[1:]
            if k == "type":
                self.next()
                return "literal", value, self.iri(self.next()), None
            return "literal", value, XSD + "string", None
        if kind == "num":
            self.next()
            return "literal", text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if kind == "word" and text in ("true", "false"):
            self.next()
            return "literal", text, XSD + "boolean", None
        n = self.node()
        return "bnode" if n.startswith("_:") else "iri", n, None, None

    def predicates(self, s: str) -> None:
        while True:
            token = self.next()
            p = RDF + "type" if token == ("word", "a") else self.iri(token)
            while True:
                self.add(s, p, self.object())
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "]", "}", "") or self.tokens[self.at - 1][1] != ";":
                return

    def parse(self) -> list[Row]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            low = text.lower()
            if low in ("@prefix", "prefix", "@base", "base"):
                self.next()
                if low.endswith("prefix"):
                    self.prefixes_name = self.next()[1].rstrip(":")
                    self.prefixes[self.prefixes_name] = self.iri(self.next())
                else:
                    self.base = self.iri(self.next())
                if low.startswith("@"):
                    self.expect(".")
                continue
            if low == "graph" and kind == "word":
                self.next()
            if self.peek()[1] == "{":
                self.block(None)
                continue
            subject_is_block = self.peek()[1] == "["
            s = self.node()
            if self.peek()[1] == "{":
                self.block(s)
                continue
            if not (subject_is_block and self.peek()[1] == "."):
                before = len(self.rows)
                self.predicates(s)
                if self.peek()[0] in ("iri", "bnode") and len(self.rows) > before:  # N-Quads
                    g = self.node()
                    self.rows[before:] = [(*r[:-1], g) for r in self.rows[before:]]
            self.expect(".")
        return self.rows

    def block(self, graph: str | None) -> None:
        self.expect("{")
        self.graph = graph
        while self.peek()[1] != "}":
            subject_is_block = self.peek()[1] == "["
            s = self.node()
            if not (subject_is_block and self.peek()[1] in (".", "}")):
                self.predicates(s)
            if self.peek()[1] == ".":
                self.next()
        self.next()
        self.graph = None


def parse_jsonld(text: str, base: str = "", label: str = "j") -> list[Row]:
    """A subset of JSON-LD: prefix and term contexts with @base, @vocab, @language and typed terms; @id, @type, @value,
    @list, @set, @graph, nested nodes."""
    rows: list[Row] = []
    count = [0]
    named: dict[str, str] = {}

    def fresh() -> str:
        count[0] += 1
        return f"_:{label}{count[0]}"

    def context(c, old: dict) -> dict:
        out = {**old, "terms": dict(old["terms"])}
        for part in c if isinstance(c, list) else [c]:
            if isinstance(part, str):
                if part.rstrip("/") not in ("http://www.w3.org/ns/csvw", "https://www.w3.org/ns/csvw"):
                    raise ValueError(f"remote contexts are not read: {part}")
                out["vocab"] = "http://www.w3.org/ns/csvw#"
                continue
            for k, v in (part or {}).items():
                if k == "@base":
                    out["base"] = urljoin(out["base"], v) if v else ""
                elif k in ("@vocab", "@language"):
                    out[k[1:]] = v
                elif k[0] != "@":
                    out["terms"][k] = v
        return out

    def expand(name: str, ctx: dict, vocab: bool) -> str:
        term = ctx["terms"].get(name) if vocab else None
        if term is not None:
            target = term.get("@id", name) if isinstance(term, dict) else term
            return target if target.startswith("@") else expand(target, ctx, target != name) if target != name else target
        if name.startswith("_:"):
            return named.setdefault(name, f"_:{label}x{name[2:]}")
        head, colon, rest = name.partition(":")
        if colon:
            if rest.startswith("//"):
                return name
            ns = ctx["terms"].get(head)
            ns = ns.get("@id") if isinstance(ns, dict) else ns
            return (ns or PREFIXES.get(head)) + rest if ns or head in PREFIXES else name
        return (ctx["vocab"] or "") + name if vocab and ctx["vocab"] else name if vocab else urljoin(ctx["base"], name)

    def add(s, p, o, g):
        rows.append(("bnode" if s.startswith("_:") else "iri", s, p, *o, g))

    def ref(n: str):
        return ("bnode" if n.startswith("_:") else "iri", n, None, None)

    def value(v, ctx, term, g):
        spec = term if isinstance(term, dict) else {}
        if isinstance(v, dict) and "@value" in v:
            x, dt, lang = v["@value"], v.get("@type"), v.get("@language")
            text, own = scalar(x)
            return "literal", text, RDF + "langString" if lang else expand(dt, ctx, True) if dt else own, lang
        if isinstance(v, dict) and "@list" in v:
            rest = RDF + "nil"
            for x in reversed(v["@list"] if isinstance(v["@list"], list) else [v["@list"]]):
                n = fresh()
                add(n, RDF + "first", value(x, ctx, term, g), g)
                add(n, RDF + "rest", ref(rest), g)
                rest = n
            return ref(rest)
        if isinstance(v, dict):
            return ref(node(v, ctx, g))
        if spec.get("@type") in ("@id", "@vocab") and isinstance(v, str):
            return ref(expand(v, ctx, spec["@type"] == "@vocab"))
        text, own = scalar(v)
        if spec.get("@type"):
            own = expand(spec["@type"], ctx, True)
        lang = spec.get("@language", ctx["language"]) if isinstance(v, str) and not spec.get("@type") else None
        return "literal", text, RDF + "langString" if lang else own, lang

    def scalar(x) -> tuple[str, str]:
        if isinstance(x, bool):
            return ("true" if x else "false"), XSD + "boolean"
        if isinstance(x, int):
            return str(x), XSD + "integer"
        if isinstance(x, float):
            return f"{Decimal(repr(x)):E}".replace("E+", "E"), XSD + "double"
        return str(x), XSD + "string"

    def node(obj: dict, ctx: dict, g) -> str:
        if "@context" in obj:
            ctx = context(obj["@context"], ctx)
        s = expand(obj["@id"], ctx, False) if "@id" in obj else fresh()
        for k, v in obj.items():
            key = expand(k, ctx, True)
            if key == "@type":
                for t in v if isinstance(v, list) else [v]:
                    add(s, RDF + "type", ref(expand(t, ctx, True)), g)
            elif key == "@graph":
                bare = set(obj) <= {"@context", "@graph"}
                for x in v if isinstance(v, list) else [v]:
                    node(x, ctx, g if bare else s)
            elif k[0] != "@" and key[0] != "@" and ":" in key:
                term = ctx["terms"].get(k)
                if isinstance(term, dict) and term.get("@container") == "@list" and not (isinstance(v, dict) and "@list" in v):
                    v = {"@list": v}
                for x in v if isinstance(v, list) else v["@set"] if isinstance(v, dict) and "@set" in v else [v]:
                    if x is not None:
                        add(s, key, value(x, ctx, term, g), g)
        return s

    start = {"base": base, "vocab": None, "language": None, "terms": {}}
    data = json.loads(text)
    for x in data if isinstance(data, list) else [data]:
        node(x, start, None)
    return rows


def parse_rdfxml(text: str, base: str = "", label: str = "r") -> list[Row]:
    rows: list[Row] = []
    count, named = [0], {}
    xml = "{http://www.w3.org/XML/1998/namespace}"
    r = "{" + RDF + "}"

    def fresh() -> str:
        count[0] += 1
        return f"_:{label}{count[0]}"

    def bnode(n: str) -> str:
        return named.setdefault(n, f"_:{label}x{n}")

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1)

    def add(s, p, kind, o, dt=None, lang=None):
        rows.append(("bnode" if s.startswith("_:") else "iri", s, p, kind, o, dt, lang, None))

    def literal(s, p, v, lang, dt=None):
        add(s, p, "literal", v, dt or (RDF + "langString" if lang else XSD + "string"), None if dt else lang)

    def description(e, base, lang) -> str:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang) or None
        s = urljoin(base, e.get(r + "about")) if e.get(r + "about") is not None else urljoin(base, "#" + e.get(r + "ID")) if e.get(r + "ID") else bnode(e.get(r + "nodeID")) if e.get(r + "nodeID") else fresh()
        if name(e.tag) != RDF + "Description":
            add(s, RDF + "type", "iri", name(e.tag))
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith(xml) and k[len(r) :] not in ("about", "ID", "nodeID") or k.startswith("{") and not k.startswith((xml, r)):
                if k == r + "type":
                    add(s, RDF + "type", "iri", urljoin(base, v))
                else:
                    literal(s, name(k), v, lang)
        item = 0
        for c in e:
            p = name(c.tag)
            if p == RDF + "li":
                item += 1
                p = f"{RDF}_{item}"
            prop(s, p, c, base, lang)
        return s

    def prop(s, p, c, base, lang):
        base, lang = c.get(xml + "base", base), c.get(xml + "lang", lang) or None
        kind, res = c.get(r + "parseType"), c.get(r + "resource")
        others = {k: v for k, v in c.attrib.items() if k.startswith("{") and not k.startswith(xml) and not (k.startswith(r) and k != r + "type")}
        if kind == "Resource":
            n = fresh()
            add(s, p, "bnode", n)
            for x in c:
                prop(n, name(x.tag), x, base, lang)
        elif kind == "Collection":
            nodes, rest = [description(x, base, lang) for x in c], RDF + "nil"
            for o in reversed(nodes):
                n = fresh()
                add(n, RDF + "first", "bnode" if o.startswith("_:") else "iri", o)
                add(n, RDF + "rest", "bnode" if rest.startswith("_:") else "iri", rest)
                rest = n
            add(s, p, "bnode" if rest.startswith("_:") else "iri", rest)
        elif kind == "Literal":
            literal(s, p, (c.text or "") + "".join(ET.tostring(x, "unicode") for x in c), None, RDF + "XMLLiteral")
        elif res is not None or c.get(r + "nodeID") or others:
            o = urljoin(base, res) if res is not None else bnode(c.get(r + "nodeID")) if c.get(r + "nodeID") else fresh()
            add(s, p, "bnode" if o.startswith("_:") else "iri", o)
            for k, v in others.items():
                add(o, RDF + "type", "iri", v) if k == r + "type" else literal(o, name(k), v, lang)
        elif len(c):
            o = description(c[0], base, lang)
            add(s, p, "bnode" if o.startswith("_:") else "iri", o)
        else:
            dt = c.get(r + "datatype")
            literal(s, p, c.text or "", lang, urljoin(base, dt) if dt else None)

    root = ET.fromstring(text)
    base = root.get(xml + "base", base)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        description(e, base, root.get(xml + "lang"))
    return rows


def parse(text: str, url: str = "", label: str = "b", kind: str = "") -> list[Row]:
    """By the suffix (the URL's, unless ``kind`` has it): RDF/XML, JSON-LD, else Turtle, TriG, N-Triples or N-Quads."""
    path = kind or re.sub(r"[?#].*$", "", url).lower()
    if path.endswith((".rdf", ".xml")):
        return parse_rdfxml(text, url, label)
    if path.endswith(".jsonld"):
        return parse_jsonld(text, url, label)
    return Turtle(text, url, label).parse()


def read_rdf(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """Quads of one file, folder or pattern. Blank-node labels are scoped by file; a folder with a format's suffix, as
    written by serialize.write, is one document, and its parts share labels."""
    if re.search(r"\.(nt|nq)(\.gz)?$", path):
        return parse_nquads(spark.read.text(path))
    runtime.ship(spark)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url, content in zip(pdf["path"], pdf["content"], strict=True):
                folder = re.match(r"(.*\.(ttl|trig|jsonld|rdf|xml))/part-[^/]*$", url)
                label = f"f{abs(hash_text(folder[1] if folder else url)):x}n"
                rows = parse(bytes(content).decode("utf-8"), base or (folder[1] if folder else url), label, "." + folder[2] if folder else "")
                yield pd.DataFrame(rows, columns=QUAD_COLUMNS, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(own, QUAD)


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def quads_of(spark: SparkSession, text: str, url: str = "") -> DataFrame:
    """Quads of a small text on the driver."""
    return spark.createDataFrame(parse(text, url), QUAD)


def as_set(quads: DataFrame) -> DataFrame:
    """A store holds each quad once."""
    return quads.dropDuplicates(QUAD_COLUMNS)
