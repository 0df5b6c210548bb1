"""Table-group descriptors: JSON in compact, expanded or mixed form -> checked, inherited dataclasses."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any
from urllib.parse import quote, urljoin

from quadloom.functions import dates, numbers, templates
from quadloom.functions.terms import BINARY, CSVW, DATATYPES, DATES, DURATIONS, MARKUP, NUMERIC, PREFIXES, RDF, STRINGS, XSD, expand_iri, is_language_tag
from quadloom.functions.values import Datatype
from quadloom.issues import Issues

CONTEXT = "http://www.w3.org/ns/csvw"
INHERITED = ["aboutUrl", "datatype", "default", "lang", "null", "ordered", "propertyUrl", "required", "separator", "textDirection", "valueUrl"]
DIRECTIONS = ("ltr", "rtl", "auto", "inherit")
# Names of encodings, and the properties that objects may have.
ENCODINGS = {"utf-8": "UTF-8", "utf8": "UTF-8", "ucs2": "UTF-16LE", "ucs-2": "UTF-16LE", "utf16le": "UTF-16LE", "utf-16le": "UTF-16LE", "latin1": "ISO-8859-1", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "utf-16": "UTF-16"}
#: Own properties of each kind of object, beside the inherited ones.
KEYS = {
    "TableGroup": ["@id", "@type", "@context", "tables", "dialect", "notes", "tableDirection", "tableSchema", "transformations"],
    "Table": ["@id", "@type", "@context", "url", "dialect", "notes", "suppressOutput", "tableDirection", "tableSchema", "transformations"],
    "Schema": ["@id", "@type", "@context", "columns", "foreignKeys", "primaryKey", "rowTitles"],
    "Column": ["@id", "@type", "name", "suppressOutput", "titles", "virtual"],
    "Dialect": ["@id", "@type", "@context", "commentPrefix", "delimiter", "doubleQuote", "encoding", "header", "headerRowCount", "lineTerminators", "quoteChar", "skipBlankRows", "skipColumns", "skipInitialSpace", "skipRows", "trim"],
    "Datatype": ["@id", "@type", "base", "format", "length", "minLength", "maxLength", "minimum", "maximum", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive"],
    "Template": ["@id", "@type", "url", "targetFormat", "scriptFormat", "titles", "source"],
}


@dataclass(frozen=True)
class Dialect:
    comment_prefix: str | None = None
    delimiter: str = ","
    double_quote: bool = True
    encoding: str = "utf-8"
    header: bool = True
    header_row_count: int | None = None
    line_terminators: tuple[str, ...] = ("\r\n", "\n")
    quote_char: str | None = '"'
    skip_blank_rows: bool = False
    skip_columns: int = 0
    skip_initial_space: bool = False
    skip_rows: int = 0
    trim: str = "false"

    @property
    def header_rows(self) -> int:
        return self.header_row_count if self.header_row_count is not None else int(self.header)


@dataclass(frozen=True)
class Column:
    name: str | None = None
    titles: dict[str, list[str]] = field(default_factory=dict)
    virtual: bool = False
    suppress: bool = False
    about_url: str | None = None
    property_url: str | None = None
    value_url: str | None = None
    datatype: Datatype = Datatype()
    default: str = ""
    lang: str = "und"
    null: tuple[str, ...] = ("",)
    ordered: bool = False
    required: bool = False
    separator: str | None = None
    text_direction: str = "inherit"

    def title(self, lang: str = "und") -> str | None:
        """The first title in exactly that language, or in none."""
        return next((self.titles[k][0] for k in (lang, "und") if self.titles.get(k)), None)


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    resource: str  # url of the table it points to
    referenced: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    url: str = ""
    id: str | None = None
    columns: tuple[Column, ...] = ()
    primary_key: tuple[str, ...] = ()
    row_titles: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    dialect: Dialect = Dialect()
    suppress: bool = False
    notes: tuple[Any, ...] = ()
    external: dict[str, Any] = field(default_factory=dict)
    schema_id: str | None = None
    defaults: Column = Column()  # inherited properties for columns that the header adds
    has_schema: bool = True


@dataclass(frozen=True)
class TableGroup:
    tables: tuple[Table, ...]
    id: str | None = None
    notes: tuple[Any, ...] = ()
    external: dict[str, Any] = field(default_factory=dict)
    lang: str = "und"
    dialect: Dialect = Dialect()


def percent_name(text: str) -> str:
    """A variable name from a title: as encodeURIComponent, and without hyphens."""
    return quote(text, safe="_.!~*'()").replace("-", "%2D")


def _compact_key(key: str) -> str:
    if key.startswith(CSVW):
        return key[len(CSVW) :]
    if key.startswith("csvw:"):
        return key[5:]
    return key


def _compact(value: Any, key: str = "") -> Any:
    """Expanded JSON-LD of the vocabulary's own properties -> compact form."""
    if isinstance(value, dict):
        if key in OWN and set(value) <= {"@value", "@type", "@language"} and "@value" in value and key not in ("titles", "title"):
            return value["@value"]
        if key in OWN and set(value) == {"@list"}:
            return [_compact(v, key) for v in value["@list"]]
        if key in ("url", "propertyUrl", "resource", "base") and set(value) == {"@id"}:
            return value["@id"]
        return {_compact_key(k): _compact(v, _compact_key(k)) if _compact_key(k) in OWN else v for k, v in value.items()}
    if isinstance(value, list) and key in OWN:
        items = [_compact(v, key) for v in value]
        return items[0] if len(items) == 1 and key in SINGLE and not isinstance(items[0], list) else items
    return value


_ALIASES = {"table": "tables", "column": "columns", "title": "titles", "foreignKey": "foreignKeys", "rowTitle": "rowTitles", "note": "notes"}
OWN = {*INHERITED, *(k for v in KEYS.values() for k in v if k[0] != "@"), "reference", "columnReference", "resource", "schemaReference", "pattern", "decimalChar", "groupChar", *_ALIASES, "lineTerminator"}
SINGLE = OWN - {*_ALIASES, "tables", "columns", "foreignKeys", "notes", "transformations", "titles", "columnReference", "lineTerminators", "rowTitles", "primaryKey", "null"}


class Loader:
    """``resolve(url) -> text`` reads sub-descriptors."""

    def __init__(self, base: str, resolve: Callable[[str], str] | None = None, issues: Issues | None = None):
        self.base, self.resolve, self.issues = base, resolve, issues or Issues()
        self.lang = "und"

    def load(self, source: str | Mapping[str, Any]) -> TableGroup:
        raw = json.loads(source) if isinstance(source, str) else json.loads(json.dumps(source))
        if isinstance(raw, list):
            raw = raw[0] if raw else {}
        if not isinstance(raw, dict):
            self.issues.error("the descriptor is not an object")
            return TableGroup(())
        self._context(raw.get("@context"))
        raw = self._keys(_compact(raw))
        self._sanity(raw)
        group = raw if "tables" in raw else {"tables": [raw], **{k: raw[k] for k in ("@context",) if k in raw}}
        return self._group(group, single="tables" not in raw)

    def _keys(self, obj: dict[str, Any]) -> dict[str, Any]:
        return {_ALIASES.get(k, k) if _ALIASES.get(k, k) not in obj else k: v for k, v in obj.items()}

    def _context(self, context: Any) -> None:
        parts = context if isinstance(context, list) else [context]
        for extra in parts[1:]:
            if not isinstance(extra, dict):
                continue
            for k in extra:
                if k not in ("@base", "@language"):
                    self.issues.error(f"the context has the key {k}")
            if "@base" in extra:
                self.base = urljoin(self.base, str(extra["@base"]))
            if "@language" in extra:
                if is_language_tag(extra["@language"]):
                    self.lang = extra["@language"]
                else:
                    self.issues.warn(f"not a language tag: {extra['@language']}")

    def _sanity(self, value: Any, inside: str = "") -> None:
        if isinstance(value, list):
            for v in value:
                self._sanity(v, inside)
        if not isinstance(value, dict):
            return
        if "@id" in value:
            if not isinstance(value["@id"], str):
                self.issues.warn("@id is not a string")
                del value["@id"]
            elif value["@id"].startswith("_:"):
                self.issues.error(f"@id is a blank node: {value['@id']}")
        if "@type" in value and "@value" not in value:
            for t in value["@type"] if isinstance(value["@type"], list) else [value["@type"]]:
                known = isinstance(t, str) and (t in KEYS or t in DATATYPES or templates.is_absolute(expand_iri(t)) or inside not in OWN)
                if not known:
                    self.issues.error(f"unknown @type {t}")
                elif isinstance(t, str) and t.startswith("_:"):
                    self.issues.error(f"@type is a blank node: {t}")
        if "@language" in value and inside not in ("@context",):
            if "@value" not in value:
                self.issues.error("@language without @value")
            elif not is_language_tag(value["@language"]):
                self.issues.error(f"not a language tag: {value['@language']}")
        for k, v in value.items():
            if k.startswith("@") and k not in ("@id", "@type", "@value", "@language", "@context", "@list", "@set", "@none"):
                self.issues.error(f"unknown keyword {k}")
            if k not in ("@context", "titles"):
                self._sanity(v, k)

    def _type(self, obj: dict[str, Any], kind: str) -> None:
        if "@type" in obj and obj["@type"] not in (kind, CSVW + kind, "csvw:" + kind) and kind in KEYS:
            self.issues.error(f"@type should be {kind}")

    def _external(self, obj: dict[str, Any], kind: str) -> dict[str, Any]:
        """Properties of other vocabularies; unknown names warn."""
        out = {}
        allowed = {*KEYS[kind], *(INHERITED if kind in ("TableGroup", "Table", "Schema", "Column") else [])}
        for k, v in obj.items():
            if k in allowed:
                continue
            if ":" in k and (k.partition(":")[0] in PREFIXES or templates.is_absolute(k)) and kind not in ("Dialect", "Datatype"):
                out[k] = v
            elif k not in OWN or k not in allowed:
                self.issues.warn(f"{kind} has no property {k}")
        return out

    def _include(self, value: Any) -> Any:
        """An IRI in place of an object is fetched."""
        if isinstance(value, str):
            url = urljoin(self.base, value)
            if not self.resolve:
                self.issues.warn(f"cannot read {url}")
                return None
            obj = self._keys(_compact(json.loads(self.resolve(url))))
            obj.pop("@context", None)
            obj.setdefault("@id", url)
            return obj
        if value is not None and not isinstance(value, dict):
            self.issues.warn("an object was expected")
            return None
        return self._keys(value) if value else value

    def _flag(self, obj: dict[str, Any], key: str, default: bool) -> bool:
        v = obj.get(key, default)
        if isinstance(v, bool):
            return v
        self.issues.warn(f"{key} is not a boolean")
        return default

    def _group(self, obj: dict[str, Any], single: bool) -> TableGroup:
        issues = self.issues
        if not single:
            self._type(obj, "TableGroup")
        external = {} if single else self._external(obj, "TableGroup")
        tables = obj.get("tables")
        if not isinstance(tables, list) or not tables:
            issues.error("a table group needs tables")
            tables = []
        if any(not isinstance(t, dict) for t in tables):
            issues.warn("a table is not an object")
            tables = [t for t in tables if isinstance(t, dict)]
        if obj.get("tableDirection", "auto") not in DIRECTIONS:
            issues.warn("tableDirection is unknown")
        inherited = self._inherited(obj) if not single else {}
        dialect = self._dialect(self._include(obj.get("dialect"))) if not single else Dialect()
        done = [self._table(self._keys(t), inherited, obj, dialect) for t in tables]
        done = [replace(t, foreign_keys=tuple(self._foreign_key(f, t, done) for f in t.foreign_keys)) for t in done]
        return TableGroup(tuple(done), None if single else obj.get("@id") and urljoin(self.base, obj["@id"]), self._notes(obj) if not single else (), external, self.lang, done[0].dialect if single and done else dialect)

    def _notes(self, obj: dict[str, Any]) -> tuple[Any, ...]:
        n = obj.get("notes", [])
        if not isinstance(n, (list, dict)):
            self.issues.warn("notes is not an array")
            return ()
        return tuple(n) if isinstance(n, list) else (n,)

    def _inherited(self, obj: dict[str, Any]) -> dict[str, Any]:
        """Checked inherited properties that the object itself sets."""
        issues, out = self.issues, {}
        for k in INHERITED:
            if k not in obj:
                continue
            v = obj[k]
            if k in ("aboutUrl", "propertyUrl", "valueUrl"):
                if not isinstance(v, str):
                    issues.warn(f"{k} is not a string")
                    continue
                try:
                    templates.parse(v)
                except ValueError as e:
                    issues.warn(str(e))
                    continue
                out[{"aboutUrl": "about_url", "propertyUrl": "property_url", "valueUrl": "value_url"}[k]] = v
            elif k == "datatype":
                out["datatype"] = self._datatype(v)
            elif k in ("ordered", "required"):
                if isinstance(v, bool):
                    out[k] = v
                else:
                    issues.warn(f"{k} is not a boolean")
            elif k == "null":
                if isinstance(v, str) or isinstance(v, list) and all(isinstance(x, str) for x in v):
                    out["null"] = (v,) if isinstance(v, str) else tuple(v)
                else:
                    issues.warn("null is not a string")
            elif k == "lang":
                if is_language_tag(v):
                    out["lang"] = v
                else:
                    issues.warn(f"not a language tag: {v}")
            elif k == "separator":
                if v is None or isinstance(v, str):
                    out["separator"] = v
                else:
                    issues.warn("separator is not a string")
            elif k == "textDirection":
                if v in DIRECTIONS:
                    out["text_direction"] = v
                else:
                    issues.warn("textDirection is unknown")
            elif isinstance(v, str):
                out["default"] = v
            else:
                issues.warn("default is not a string")
        return out

    def _datatype(self, v: Any) -> Datatype:
        issues = self.issues
        if isinstance(v, str):
            v = {"base": v}
        if not isinstance(v, dict):
            issues.warn("datatype is neither a string nor an object")
            return Datatype()
        self._external(v, "Datatype")
        base = v.get("base", "string")
        if isinstance(base, str) and base.startswith(XSD):
            base = base[len(XSD) :]
        if base not in DATATYPES:
            issues.warn(f"unknown datatype {base}")
            base, v = "string", {k: x for k, x in v.items() if k == "@id"}
        own = v.get("@id")
        if own is not None and expand_iri(own) in {XSD + d for d in DATATYPES}:
            issues.error(f"@id of a datatype is a built-in one: {own}")
        lengths = {}
        for k in ("length", "minLength", "maxLength"):
            if k in v:
                if not str(v[k]).lstrip("+").isdigit():
                    issues.warn(f"{k} is not a number")
                    continue
                if base not in (*STRINGS, *BINARY, *MARKUP, "anyURI", "anyAtomicType", "any"):
                    issues.error(f"{k} does not go with {base}")
                lengths[k] = int(v[k])
        lo, hi, n = lengths.get("minLength"), lengths.get("maxLength"), lengths.get("length")
        if (n is not None and (lo is not None and n < lo or hi is not None and n > hi)) or (lo is not None and hi is not None and lo > hi):
            issues.error("length facets contradict each other")
        bounds = {}
        for k, to in (("minimum", "minInclusive"), ("maximum", "maxInclusive"), *((x, x) for x in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"))):
            if k in v:
                if base not in (*NUMERIC, *DATES, *DURATIONS, "gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth"):
                    issues.error(f"{k} does not go with {base}")
                    continue
                bounds[to] = str(v[k])
        if {"minInclusive", "minExclusive"} <= set(bounds) or {"maxInclusive", "maxExclusive"} <= set(bounds):
            issues.error("inclusive and exclusive bounds together")
        measure = float if base in NUMERIC else dates.seconds_of_duration if base in DURATIONS else dates.seconds_of_date if base in DATES else None
        if measure:
            try:
                low = [measure(x) for k, x in bounds.items() if k.startswith("min")]
                high = [measure(x) for k, x in bounds.items() if k.startswith("max")]
            except ValueError:
                issues.warn(f"a bound is not a {'number' if base in NUMERIC else base}")
                low, high, bounds = [], [], {}
            if low and high and (low[0] > high[0] or low[0] == high[0] and any(k.endswith("Exclusive") for k in bounds)):
                issues.error("the bounds leave no value")
        return Datatype(base, own, self._format(v.get("format"), base), n, lo, hi, bounds)

    def _format(self, fmt: Any, base: str) -> Any:
        issues = self.issues
        if fmt is None:
            return None
        try:
            if base in NUMERIC:
                if isinstance(fmt, dict):
                    if fmt.get("pattern"):
                        numbers.compile_pattern(fmt["pattern"])
                    return {k: fmt[k] for k in ("pattern", "decimalChar", "groupChar") if isinstance(fmt.get(k), str)}
                numbers.compile_pattern(fmt)
                return fmt
            if not isinstance(fmt, str):
                issues.warn("format is not a string")
                return None
            if base == "boolean" and (fmt.count("|") != 1 or fmt.split("|")[0] == fmt.split("|")[1]):
                issues.warn(f"not a boolean format: {fmt}")
                return None
            if base in DATES:
                dates.pattern_regex(fmt, base)
                if not any(f for f, _ in dates.tokens(fmt)):
                    raise ValueError(f"not a date pattern: {fmt}")
            elif base != "boolean":
                re.compile(fmt)
            return fmt
        except (ValueError, TypeError, re.error):
            issues.warn(f"format {fmt} does not go with {base}")
            return None

    def _dialect(self, obj: dict[str, Any] | None) -> Dialect:
        issues, out = self.issues, {}
        if not obj:
            return Dialect()
        self._type(obj, "Dialect")
        self._external(obj, "Dialect")
        text = {"commentPrefix": "comment_prefix", "delimiter": "delimiter", "quoteChar": "quote_char"}
        flags = {"doubleQuote": "double_quote", "header": "header", "skipBlankRows": "skip_blank_rows", "skipInitialSpace": "skip_initial_space"}
        counts = {"headerRowCount": "header_row_count", "skipColumns": "skip_columns", "skipRows": "skip_rows"}
        for k, v in obj.items():
            ok = True
            if k in text:
                ok = isinstance(v, str) or v is None and k != "delimiter"
                out |= {text[k]: v} if ok else {}
            elif k in flags:
                ok = isinstance(v, bool)
                out |= {flags[k]: v} if ok else {}
            elif k in counts:
                ok = isinstance(v, int) and not isinstance(v, bool) and v >= 0
                out |= {counts[k]: v} if ok else {}
            elif k == "encoding":
                ok = isinstance(v, str) and v.lower() in ENCODINGS
                out |= {"encoding": v.lower()} if ok else {}
            elif k == "lineTerminators":
                v = [v] if isinstance(v, str) else v
                ok = isinstance(v, list) and all(isinstance(x, str) for x in v) and bool(v)
                out |= {"line_terminators": tuple(v)} if ok else {}
            elif k == "trim":
                v = {True: "true", False: "false"}.get(v, v) if isinstance(v, bool) else v
                ok = v in ("true", "false", "start", "end")
                out |= {"trim": v} if ok else {}
            if not ok:
                issues.warn(f"the dialect's {k} is invalid")
        return Dialect(**out)

    def _table(self, obj: dict[str, Any], inherited: dict[str, Any], group: dict[str, Any], dialect: Dialect) -> Table:
        issues = self.issues
        self._type(obj, "Table")
        external = self._external(obj, "Table")
        url = obj.get("url")
        if not isinstance(url, str):
            issues.error("a table needs a url")
            url = ""
        url = urljoin(self.base, url)
        with issues.at(table=url):
            own = inherited | self._inherited(obj)
            schema = self._include(obj.get("tableSchema", group.get("tableSchema"))) or {}
            self._type(schema, "Schema")
            self._external(schema, "Schema")
            own = own | self._inherited(schema)
            columns = schema.get("columns", [])
            if not isinstance(columns, list):
                issues.warn("columns is not an array")
                columns = []
            done = [self._column(c, own) for c in columns if isinstance(c, dict)]
            if len(done) < len(columns):
                issues.warn("a column is not an object")
            for i, c in enumerate(done):
                if not c.virtual and any(x.virtual for x in done[:i]):
                    issues.error("a virtual column stands before a physical one")
            done.sort(key=lambda c: c.virtual)
            names = name_columns(done, self.lang)
            if len(set(names)) < len(names):
                issues.error("two columns have one name")
            as_names = lambda v: tuple([v] if isinstance(v, str) else [x for x in v if isinstance(x, str)]) if isinstance(v, (str, list)) else ()
            keys = {}
            for k in ("primaryKey", "rowTitles"):
                keys[k] = as_names(schema.get(k, []))
                if any(x not in names for x in keys[k]):
                    issues.warn(f"{k} names an unknown column")
                    keys[k] = ()
            fks = schema.get("foreignKeys", [])
            if not isinstance(fks, list):
                issues.warn("foreignKeys is not an array")
                fks = []
            if obj.get("tableDirection", "auto") not in DIRECTIONS:
                issues.warn("tableDirection is unknown")
            for t in obj.get("transformations", []) if isinstance(obj.get("transformations", []), list) else []:
                if isinstance(t, dict):
                    self._external(t, "Template")
                    if not {"url", "targetFormat", "scriptFormat"} <= set(t):
                        issues.warn("a transformation lacks a property")
            return Table(url, obj.get("@id") and urljoin(self.base, obj["@id"]), tuple(replace(c, name=n) for c, n in zip(done, names, strict=True)), keys["primaryKey"], keys["rowTitles"], tuple(fks),
                         self._dialect(self._include(obj["dialect"])) if "dialect" in obj else dialect, self._flag(obj, "suppressOutput", False), self._notes(obj), external, schema.get("@id") and urljoin(self.base, schema["@id"]),
                         Column(**own), "columns" in schema)

    def _column(self, obj: dict[str, Any], inherited: dict[str, Any]) -> Column:
        obj = self._keys(obj)
        issues = self.issues
        self._type(obj, "Column")
        self._external(obj, "Column")
        titles: dict[str, list[str]] = {}
        raw = obj.get("titles")
        if isinstance(raw, dict) and "@value" in raw:
            raw = {raw.get("@language", self.lang): raw["@value"]}
        if isinstance(raw, list) and any(isinstance(x, dict) for x in raw):
            raw = {x.get("@language", self.lang): x.get("@value") for x in raw if isinstance(x, dict)}
        if isinstance(raw, (str, list)):
            raw = {self.lang: raw}
        if isinstance(raw, dict):
            for k, v in raw.items():
                items = [v] if isinstance(v, str) else v
                if not is_language_tag(k) or not isinstance(items, list) or not all(isinstance(x, str) for x in items):
                    issues.warn("titles are invalid")
                    continue
                titles[k] = list(items)
        elif raw is not None:
            issues.warn("titles are invalid")
        name = obj.get("name")
        if name is not None and (not isinstance(name, str) or not templates.is_variable_name(name) or name.startswith("_")):
            issues.warn(f"not a column name: {name}")
            name = None
        return Column(**{**inherited, **self._inherited(obj), "name": name, "titles": titles, "virtual": self._flag(obj, "virtual", False), "suppress": self._flag(obj, "suppressOutput", False)})

    def _foreign_key(self, fk: Any, table: Table, tables: list[Table]) -> ForeignKey:
        issues = self.issues
        own = lambda v: tuple([v] if isinstance(v, str) else v or ())
        with issues.at(table=table.url):
            if not isinstance(fk, dict) or not isinstance(fk.get("reference"), dict):
                issues.error("a foreign key needs a reference")
                return ForeignKey((), "", ())
            extra = set(fk) - {"columnReference", "reference"} | set(fk["reference"]) - {"resource", "schemaReference", "columnReference"}
            if extra:
                issues.error(f"a foreign key has the property {sorted(extra)[0]}")
            ref, cols, to = fk["reference"], own(fk.get("columnReference")), own(fk["reference"].get("columnReference"))
            if "resource" in ref:
                target = next((t for t in tables if t.url == urljoin(self.base, ref["resource"])), None)
            else:
                target = next((t for t in tables if t.schema_id and t.schema_id == urljoin(self.base, ref.get("schemaReference", ""))), None)
            if target is None:
                issues.error("a foreign key points to an unknown table")
                return ForeignKey(cols, "", to)
            if any(c not in {x.name for x in table.columns} for c in cols) or any(c not in {x.name for x in target.columns} for c in to):
                issues.error("a foreign key names an unknown column")
            return ForeignKey(cols, target.url, to)


def name_columns(columns: list[Column], lang: str) -> list[str]:
    """Names: own, else from a title, else by number."""
    return [c.name or (percent_name(t) if (t := c.title(lang)) else f"_col.{i + 1}") for i, c in enumerate(columns)]


def external_quads(value: Any, subject: str, prop: str, lang: str = "und", label: str = "n") -> list[tuple]:
    """JSON-LD subset (values, ids, types, lists, nested objects) of one property -> quad rows."""
    out: list[tuple] = []
    counter = [0]

    def kind(node: str) -> str:
        return "bnode" if node.startswith("_:") else "iri"

    def node() -> str:
        counter[0] += 1
        return f"_:{label}{counter[0]}"

    def emit(s: str, p: str, v: Any) -> None:
        p = expand_iri(p)
        if isinstance(v, list):
            for x in v:
                emit(s, p, x)
            return
        if isinstance(v, dict):
            if "@value" in v:
                x, dt = v["@value"], v.get("@type")
                text = ("true" if x else "false") if isinstance(x, bool) else str(x)
                out.append((kind(s), s, p, "literal", text, expand_iri(dt) if dt else RDF + "langString" if "@language" in v else XSD + ("boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "double" if isinstance(x, float) else "string"), v.get("@language"), None))
                return
            if "@list" in v:
                rest = RDF + "nil"
                for x in reversed(v["@list"]):
                    n = node()
                    emit(n, RDF + "first", x)
                    out.append((kind(n), n, RDF + "rest", kind(rest), rest, None, None, None))
                    rest = n
                out.append((kind(s), s, p, kind(rest), rest, None, None, None))
                return
            if "@set" in v:
                emit(s, p, v["@set"])
                return
            o = expand_iri(v["@id"]) if "@id" in v else node()
            out.append((kind(s), s, p, kind(o), o, None, None, None))
            for k, x in v.items():
                if k == "@type":
                    for t in x if isinstance(x, list) else [x]:
                        out.append((kind(o), o, RDF + "type", "iri", expand_iri(t), None, None, None))
                elif k[0] != "@":
                    emit(o, k, x)
            return
        if isinstance(v, bool):
            out.append((kind(s), s, p, "literal", "true" if v else "false", XSD + "boolean", None, None))
        elif isinstance(v, int):
            out.append((kind(s), s, p, "literal", str(v), XSD + "integer", None, None))
        elif isinstance(v, float):
            out.append((kind(s), s, p, "literal", repr(v), XSD + "double", None, None))
        elif v is not None:
            tagged = lang not in ("und", "@none")
            out.append((kind(s), s, p, "literal", str(v), RDF + "langString" if tagged else XSD + "string", lang if tagged else None, None))

    emit(subject, prop, value)
    return out


def all_urls(value: Any) -> set[str]:
    """Every absolute URL among a descriptor's strings."""
    if isinstance(value, str):
        return {value} if re.match(r"^https?://", value) else set()
    if isinstance(value, dict):
        return set().union(*map(all_urls, value.values())) if value else set()
    if isinstance(value, list):
        return set().union(*map(all_urls, value)) if value else set()
    return set()
