"""RDF terms, datatypes and prefixes. Quads are flat string columns, see QUAD."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quad table: kinds are iri, bnode, literal; a null graph is the default graph.
QUAD = "s_kind string, s string, p string, o_kind string, o string, o_dt string, o_lang string, g string"
QUAD_COLUMNS = ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang", "g"]

# The RDFa core initial context, in its order.
PREFIXES = {
    "as": "https://www.w3.org/ns/activitystreams#", "cc": "http://creativecommons.org/ns#", "csvw": "http://www.w3.org/ns/csvw#",
    "ctag": "http://commontag.org/ns#", "dc": "http://purl.org/dc/terms/", "dc11": "http://purl.org/dc/elements/1.1/",
    "dcat": "http://www.w3.org/ns/dcat#", "dcterms": "http://purl.org/dc/terms/", "dqv": "http://www.w3.org/ns/dqv#",
    "duv": "http://www.w3.org/ns/duv#", "earl": "http://www.w3.org/ns/earl#", "foaf": "http://xmlns.com/foaf/0.1/",
    "gr": "http://purl.org/goodrelations/v1#", "grddl": "http://www.w3.org/2003/g/data-view#", "ical": "http://www.w3.org/2002/12/cal/icaltzd#",
    "jsonld": "http://www.w3.org/ns/json-ld#", "ldp": "http://www.w3.org/ns/ldp#", "ma": "http://www.w3.org/ns/ma-ont#",
    "oa": "http://www.w3.org/ns/oa#", "odrl": "http://www.w3.org/ns/odrl/2/", "og": "http://ogp.me/ns#", "org": "http://www.w3.org/ns/org#",
    "owl": "http://www.w3.org/2002/07/owl#", "prov": "http://www.w3.org/ns/prov#", "qb": "http://purl.org/linked-data/cube#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfa": "http://www.w3.org/ns/rdfa#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "rev": "http://purl.org/stuff/rev#", "rif": "http://www.w3.org/2007/rif#", "rr": "http://www.w3.org/ns/r2rml#", "schema": "http://schema.org/",
    "sd": "http://www.w3.org/ns/sparql-service-description#", "sioc": "http://rdfs.org/sioc/ns#", "skos": "http://www.w3.org/2004/02/skos/core#",
    "skosxl": "http://www.w3.org/2008/05/skos-xl#", "sosa": "http://www.w3.org/ns/sosa/", "ssn": "http://www.w3.org/ns/ssn/",
    "time": "http://www.w3.org/2006/time#", "v": "http://rdf.data-vocabulary.org/#", "vcard": "http://www.w3.org/2006/vcard/ns#",
    "void": "http://rdfs.org/ns/void#", "wdr": "http://www.w3.org/2007/05/powder#", "wdrs": "http://www.w3.org/2007/05/powder-s#",
    "xhv": "http://www.w3.org/1999/xhtml/vocab#", "xml": "http://www.w3.org/XML/1998/namespace", "xsd": "http://www.w3.org/2001/XMLSchema#",
}
RDF, RDFS, XSD, CSVW, SKOS = (PREFIXES[k] for k in ("rdf", "rdfs", "xsd", "csvw", "skos"))

# The datatypes' names, the URIs that do not follow from them, and their derivation.
INTEGERS = ["integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "nonPositiveInteger", "negativeInteger"]
NUMERIC = [*INTEGERS, "decimal", "double", "float", "number"]
DATES = ["date", "dateTime", "datetime", "time", "dateTimeStamp"]
PARTIAL_DATES = ["gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth"]
DURATIONS = ["duration", "dayTimeDuration", "yearMonthDuration"]
STRINGS = ["string", "normalizedString", "token", "language", "Name", "NMTOKEN"]
MARKUP = ["xml", "html", "json"]
BINARY = ["base64Binary", "binary", "hexBinary"]
OTHER = ["anyURI", "QName", "anyAtomicType", "any", "boolean"]
DATATYPES = [*NUMERIC, *DATES, *PARTIAL_DATES, *DURATIONS, *STRINGS, *MARKUP, *BINARY, *OTHER]
_ODD_URIS = {"any": XSD + "anyAtomicType", "binary": XSD + "base64Binary", "datetime": XSD + "dateTime", "number": XSD + "double", "html": RDF + "HTML", "json": CSVW + "JSON", "xml": RDF + "XMLLiteral"}
DATATYPE_URI = {d: _ODD_URIS.get(d, XSD + d) for d in DATATYPES}
#: Of several names for a URI the short alias names it.
URI_DATATYPE = {**{u: d for d, u in DATATYPE_URI.items() if d not in _ODD_URIS}, XSD + "base64Binary": "binary", XSD + "dateTime": "dateTime", **{_ODD_URIS[k]: k for k in ("html", "json", "xml", "number")}, XSD + "anyAtomicType": "anyAtomicType"}

#: Derivation: each datatype's parent.
PARENT = {
    "integer": "decimal", "long": "integer", "int": "long", "short": "int", "byte": "short", "nonNegativeInteger": "integer", "positiveInteger": "nonNegativeInteger",
    "unsignedLong": "nonNegativeInteger", "unsignedInt": "unsignedLong", "unsignedShort": "unsignedInt", "unsignedByte": "unsignedShort",
    "nonPositiveInteger": "integer", "negativeInteger": "nonPositiveInteger", "dateTimeStamp": "dateTime", "dayTimeDuration": "duration", "yearMonthDuration": "duration",
    "normalizedString": "string", "token": "normalizedString", "language": "token", "Name": "token", "NMTOKEN": "token", "xml": "string", "html": "string", "json": "string",
}


def ancestors(datatype: str) -> list[str]:
    """From the datatype up to anyAtomicType."""
    alias = {"any": "anyAtomicType", "binary": "base64Binary", "datetime": "dateTime", "number": "double"}
    out = [alias.get(datatype, datatype)]
    while out[-1] != "anyAtomicType":
        out.append(PARENT.get(out[-1], "anyAtomicType"))
    return out


def common_ancestor(datatypes: list[str]) -> str:
    """The least datatype that all derive from."""
    if not datatypes:
        return "anyAtomicType"
    rest = [set(ancestors(d)) for d in datatypes[1:]]
    return next(a for a in ancestors(datatypes[0]) if all(a in r for r in rest))


def expand_iri(text: str) -> str:
    """prefix:rest -> IRI for known prefixes."""
    head, colon, rest = text.partition(":")
    return PREFIXES[head] + rest if colon and head in PREFIXES and not rest.startswith("//") else text


def expand_iri_column(text: Column) -> Column:
    head = F.substring_index(text, ":", 1)
    table = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    rest = F.regexp_replace(text, "^[^:]*:", "")
    known = text.contains(":") & ~rest.startswith("//")
    return F.coalesce(F.when(known, F.concat(F.try_element_at(table, head), rest)), text)


def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, "[^#/]*$", 0)


def namespace(iri: Column) -> Column:
    return F.regexp_replace(iri, "[^#/]*$", "")


def datatype_name(o_kind: Column, o_dt: Column) -> Column:
    """anyURI for nodes; the datatype's name for literals, anyAtomicType if it is none of the built-in ones."""
    table = F.create_map(*[F.lit(x) for kv in URI_DATATYPE.items() for x in kv])
    return F.when(o_kind != "literal", F.lit("anyURI")).otherwise(F.coalesce(F.try_element_at(table, F.coalesce(o_dt, F.lit(XSD + "string"))), F.lit("anyAtomicType")))


_TAG = re.compile(r"^(?:(?:[a-zA-Z]{2,3}(?:-[a-zA-Z]{3}){0,3}|[a-zA-Z]{4,8})(?:-[a-zA-Z]{4})?(?:-(?:[a-zA-Z]{2}|\d{3}))?(?:-(?:[a-zA-Z0-9]{5,8}|\d[a-zA-Z0-9]{3}))*(?:-[0-9a-wy-zA-WY-Z](?:-[a-zA-Z0-9]{2,8})+)*(?:-x(?:-[a-zA-Z0-9]{1,8})+)?|x(?:-[a-zA-Z0-9]{1,8})+)$")


def is_language_tag(tag: object) -> bool:
    return isinstance(tag, str) and bool(_TAG.match(tag))
