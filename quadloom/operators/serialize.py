"""Quads to text: N-Triples and N-Quads natively, Turtle, TriG and JSON-LD per subject; prefixes in use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import runtime
from quadloom.functions.terms import PREFIXES, RDF, XSD

# Format names, media types and suffixes.
FORMATS = {"ntriples": ("application/n-triples", ".nt"), "nquads": ("application/n-quads", ".nq"), "turtle": ("text/turtle", ".ttl"), "trig": ("application/trig", ".trig"), "jsonld": ("application/ld+json", ".jsonld")}


def format_of(path: str, default: str = "turtle") -> str:
    return next((k for k, (_, suffix) in FORMATS.items() if path.endswith(suffix)), default)


def _escaped(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    odd = F.regexp_extract_all(x, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"), F.lit(0))  # other control characters are rare
    coded = F.aggregate(F.array_distinct(odd), x, lambda t, c: F.replace(t, c, F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))))
    return F.when(x.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"), coded).otherwise(x)


#: Characters that an IRI reference must not hold.
_NOT_IN_IRIS = "[\\x00-\\x20<>\"{}|^`\\\\]"


def _iri(x: Column) -> Column:
    """The IRI in angle brackets; characters that it must not hold are escaped."""
    odd = F.array_distinct(F.regexp_extract_all(x, F.lit(_NOT_IN_IRIS), F.lit(0)))
    first = F.when(x.contains("\\"), F.replace(x, F.lit("\\"), F.lit("\\u005C"))).otherwise(x)  # escapes hold backslashes
    coded = F.aggregate(F.filter(odd, lambda c: c != "\\"), first, lambda t, c: F.replace(t, c, F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))))
    return F.concat(F.lit("<"), F.when(x.rlike(_NOT_IN_IRIS), coded).otherwise(x), F.lit(">"))


def _term(kind: Column, x: Column) -> Column:
    return F.when(kind == "iri", _iri(x)).otherwise(F.when(x.startswith("_:"), x).otherwise(F.concat(F.lit("_:"), x)))


def _object() -> Column:
    text = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))
    literal = F.when(F.col("o_lang").isNotNull(), F.concat(text, F.lit("@"), "o_lang")).when(F.coalesce("o_dt", F.lit(XSD + "string")) == XSD + "string", text).otherwise(F.concat(text, F.lit("^^"), _iri(F.col("o_dt"))))
    return F.when(F.col("o_kind") == "literal", literal).otherwise(_term(F.col("o_kind"), F.col("o")))


def lines(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """One N-Quads (or N-Triples) line per quad."""
    parts = [_term(F.col("s_kind"), F.col("s")), _iri(F.col("p")), _object()]
    if graphs:
        g = F.col("g")
        parts.append(F.when(g.isNotNull(), F.when(g.startswith("_:"), g).otherwise(_iri(g))))
    return quads.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value"))


def turtle_blocks(quads: DataFrame, prefixes: dict[str, str] | None = None, graphs: bool = False) -> DataFrame:
    """One block of text per subject (and graph), prefixes applied."""
    table = dict(prefixes or PREFIXES)
    object_text = _object()

    def qname(x: Column) -> Column:
        out = _iri(x)
        local = F.regexp_extract(x, r"[^#/]*$", 0)
        ns = F.substring(x, F.lit(1), F.length(x) - F.length(local))
        names = F.create_map(*[F.lit(v) for k, n in reversed(table.items()) for v in (n, k)]) if len(set(table.values())) == len(table) else F.create_map(*[F.lit(v) for n, k in {n: k for k, n in reversed(table.items())}.items() for v in (n, k)])
        prefix = F.try_element_at(names, ns)
        return F.when(prefix.isNotNull() & local.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(prefix, F.lit(":"), local)).otherwise(out)

    p = F.when(F.col("p") == RDF + "type", F.lit("a")).otherwise(qname(F.col("p")))
    o = F.when(F.col("o_kind") == "iri", qname(F.col("o"))).when((F.col("o_kind") == "literal") & F.col("o_lang").isNull() & (F.coalesce("o_dt", F.lit(XSD + "string")) != XSD + "string"),
                                                              F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"^^'), qname(F.col("o_dt")))).otherwise(object_text)
    s = F.when(F.col("s_kind") == "iri", qname(F.col("s"))).otherwise(F.col("s"))
    pairs = quads.select("g", s.alias("s"), p.alias("p"), o.alias("o")).distinct()
    per = pairs.groupBy("g", "s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("o"))
    per = per.groupBy("g", "s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n  ").alias("body"))
    block = F.concat("s", F.lit(" "), "body", F.lit(" ."))
    if graphs:
        block = F.when(F.col("g").isNotNull(), F.concat(F.lit("<"), "g", F.lit("> {\n"), block, F.lit("\n}"))).otherwise(block)
    return per.select(block.alias("value"))


def prefix_lines(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in prefixes.items())


def jsonld(quads: DataFrame) -> DataFrame:
    """One JSON node object per subject and graph, in a 'value' column."""
    runtime.ship(quads.sparkSession)
    q = F.struct("p", "o_kind", "o", "o_dt", "o_lang")
    rows = quads.distinct().groupBy("g", "s").agg(F.array_sort(F.collect_list(q)).alias("q"))

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            out = []
            for g, s, items in zip(pdf["g"], pdf["s"], pdf["q"], strict=True):
                obj: dict = {"@id": s}
                for x in items:
                    if x["p"] == RDF + "type" and x["o_kind"] != "literal":
                        obj.setdefault("@type", []).append(x["o"])
                        continue
                    v = {"@id": x["o"]} if x["o_kind"] != "literal" else {"@value": x["o"]} | ({"@language": x["o_lang"]} if x["o_lang"] else {"@type": x["o_dt"]} if x["o_dt"] and x["o_dt"] != XSD + "string" else {})
                    obj.setdefault(x["p"], []).append(v)
                out.append(json.dumps({"@id": g, "@graph": [obj]} if g is not None else obj, ensure_ascii=False))
            yield pd.DataFrame({"value": out})

    return rows.mapInPandas(nodes, "value string")


#: Subject blocks of one Turtle or TriG file: such files are parsed whole.
BLOCKS = 20_000


def write(quads: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    """Part files of lines or subject blocks; the folder is one document, so its parts share blank-node labels. Turtle
    and TriG parts hold at most BLOCKS blocks and each repeat the prefixes they may use, JSON-LD parts are one array each.
    ``mode`` "append" adds parts to the document."""
    fmt = fmt or format_of(path)
    if fmt in ("ntriples", "nquads"):
        lines(quads, fmt == "nquads").write.mode(mode).text(path)
    elif fmt in ("turtle", "trig"):
        head, size = prefix_lines(PREFIXES), BLOCKS

        def with_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = 0  # blocks in the file that is being written: Spark begins the next one after size + 1 rows
            for pdf in batches:
                while len(pdf):
                    if at == 0:
                        yield pd.DataFrame({"value": [head]})
                    own, pdf = pdf.iloc[: size - at], pdf.iloc[size - at :]
                    at = (at + len(own)) % size
                    yield own

        runtime.ship(quads.sparkSession)
        turtle_blocks(quads, graphs=fmt == "trig").mapInPandas(with_head, "value string").write.mode(mode).option("maxRecordsPerFile", size + 1).text(path)
    elif fmt == "jsonld":
        def as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each part file is one JSON array, an object a line."""
            yield pd.DataFrame({"value": ["["]})
            held = None
            for pdf in batches:
                for value in pdf["value"]:
                    if held is not None:
                        yield pd.DataFrame({"value": [held + ","]})
                    held = value
            yield pd.DataFrame({"value": ["]"] if held is None else [held, "]"]})

        jsonld(quads).mapInPandas(as_array, "value string").write.mode(mode).text(path)
    else:
        raise ValueError(f"cannot write {fmt}")


def prefix_candidates(quads: DataFrame) -> DataFrame:
    """Distinct namespaces of all IRIs, with the known prefix of each."""
    iris = F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")))
    ns = quads.select(F.explode(iris).alias("iri")).where("iri is not null").select(F.regexp_extract("iri", r"^(.*?#|.*/)", 1).alias("namespace")).where("namespace <> ''").distinct()
    known = {v: k for k, v in reversed(PREFIXES.items())}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return ns.withColumn("prefix", F.try_element_at(table, F.col("namespace")))
