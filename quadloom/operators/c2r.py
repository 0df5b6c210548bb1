"""Tables to RDF: one narrow projection per table. A row's quads are an array of structs, inlined once; no shuffle, no
Python. Blank nodes are labelled by table, row and role, so retried tasks give the same labels."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import templates, values
from quadloom.functions.terms import CSVW, QUAD, QUAD_COLUMNS, RDF, XSD
from quadloom.issues import ISSUE, Issues
from quadloom.plans.descriptor import Column, Table, TableGroup, external_quads


@dataclass(frozen=True)
class Options:
    minimal: bool = False
    pretty_iris: bool = True
    #: Number of the first column in _column and _sourceColumn.
    first_column: int = 1


def cells(df: DataFrame, table: Table) -> DataFrame:
    """_row, and per column i: x{i}, a struct of lex (text or array), ok, null, or null where there is no cell."""
    texts = []
    physical = [c for c in table.columns if not c.virtual]
    for i, c in enumerate(physical):
        raw = F.col(f"_c{i}") if f"_c{i}" in df.columns else F.lit("")
        t = values.white_space(raw, c.datatype.base) if not c.separator else raw
        texts.append(F.when(t == "", F.lit(c.default)).otherwise(t).alias(f"t{i}"))
    keep = [c for c in df.columns if not c.startswith("_c") or c == "_cells"]
    staged = df.select(*keep, *texts)
    out = []
    for i, c in enumerate(physical):
        t = F.col(f"t{i}")
        null = t.isin(list(c.null))
        if c.separator is None:
            ok, lex = values.check(t, c.datatype)
            out.append(F.struct(F.when(~null, lex).alias("lex"), (ok | null).alias("ok")).alias(f"x{i}"))
        else:
            base = c.datatype.base
            quoted = "\\Q" + c.separator + "\\E"
            items = F.filter(F.transform(F.split(t, quoted, -1), _item_trim(base)), _not_in(c.null))
            both = F.transform(items, _item_check(c))
            empty = F.array().cast("array<struct<lex:string,ok:boolean>>")
            out.append(F.struct(F.when(null & (t != ""), None).when(t == "", empty).otherwise(both).alias("lex"), F.lit(True).alias("ok")).alias(f"x{i}"))
    return staged.select(*keep, *out)


def _item_trim(base: str):
    return (lambda x: x) if base in ("string", "anyAtomicType", "any") else (lambda x: values.white_space(F.trim(x), base))


def _not_in(null: tuple[str, ...]):
    return lambda x: ~x.isin(list(null))


def _item_check(c: Column):
    def check(x: C) -> C:
        ok, lex = values.check(x, c.datatype)
        return F.struct(lex.alias("lex"), ok.alias("ok"))

    return check


def quad(s_kind: C | str, s: C, p: C | str, o_kind: C | str, o: C, dt: C | str | None = None, lang: str | None = None) -> C:
    lit = lambda x: x if isinstance(x, C) else F.lit(x).cast("string")
    return F.struct(lit(s_kind).alias("s_kind"), s.alias("s"), lit(p).alias("p"), lit(o_kind).alias("o_kind"), o.cast("string").alias("o"), lit(dt).alias("o_dt"), lit(lang).alias("o_lang"), F.lit(None).cast("string").alias("g"))


def _literal(c: Column, s_kind: C | str, s: C, p: C | str, lex: C, ok: C) -> C:
    uri = c.datatype.uri
    lang = c.lang if uri == XSD + "string" and c.lang != "und" else None
    dt = RDF + "langString" if lang else uri
    return quad(s_kind, s, p, "literal", lex, F.when(ok, F.lit(dt)).otherwise(F.lit(XSD + "string")) if not lang else dt, lang)


def _item_literal(c: Column, s_kind: C | str, s: C, p: C):
    return lambda v: _literal(c, s_kind, s, p, v["lex"], v["ok"])


def _item_title(row_node: C, dt: str, lang: str | None):
    return lambda v: quad("bnode", row_node, CSVW + "title", "literal", v["lex"], dt, lang)


def _list_node(ordinal: int, row: C, j: int):
    return lambda i: F.concat(F.lit(f"_:t{ordinal}r"), row, F.lit(f"c{j}i"), i.cast("string"))


def _list_cells(c: Column, node, size: C):
    """first and rest of each list cell."""
    def rest(v: C, i: C) -> C:
        more = i + 1 < size
        return quad("bnode", node(i), RDF + "rest", F.when(more, F.lit("bnode")).otherwise(F.lit("iri")), F.when(more, node(i + 1)).otherwise(F.lit(RDF + "nil")))

    return [lambda v, i: _literal(c, "bnode", node(i), RDF + "first", v["lex"], v["ok"]), rest]


def row_quads(df: DataFrame, table: Table, ordinal: int = 0, options: Options = Options()) -> DataFrame:
    """All quads of a table's rows."""
    own = cells(df, table)
    physical = [c for c in table.columns if not c.virtual]
    row = F.col("_row").cast("string")
    source_row = (F.col("_row") + table.dialect.header_rows + table.dialect.skip_rows).cast("string")
    base = {"_row": row, "_sourceRow": source_row}
    lists = set()
    for i, c in enumerate(physical):
        x = F.col(f"x{i}.lex")
        base[c.name] = F.transform(x, lambda v: v["lex"]) if c.separator is not None else x
        if c.separator is not None:
            lists.add(c.name)
    row_node, plain_subject = F.concat(F.lit(f"_:t{ordinal}r"), row), F.concat(F.lit(f"_:t{ordinal}r"), row, F.lit("s"))
    staged = Staged(own, options.pretty_iris)
    predicates: list[str] = []
    single: list[C] = []  # structs, null where absent
    many: list[C] = []  # arrays of structs
    none = F.lit(None).cast("struct<" + QUAD.replace(" string", ":string").replace(" ", "") + ">")
    for j, c in enumerate(table.columns):
        if c.suppress:
            continue
        number = F.lit(str(j + options.first_column))
        names = base | {"_name": F.lit(c.name), "_column": number, "_sourceColumn": F.lit(str(j + options.first_column + table.dialect.skip_columns))}
        iri = lambda t, names=names, j=j: staged.iri(t, j, lambda pretty: templates.to_iri(t, table.url, names, lists, pretty))
        s_kind, s = ("iri", iri(c.about_url)) if c.about_url else ("bnode", plain_subject)
        p = iri(c.property_url) if c.property_url else F.lit(f"{table.url}#{c.name}")
        predicates.append(c.property_url if c.property_url else f"{table.url}#{c.name}")
        if c.virtual:
            if not c.value_url:
                continue
            made, there = quad(s_kind, s, p, "iri", iri(c.value_url)), F.lit(True)
            single.append(made)
        else:
            x = F.col(f"x{j}")
            there = x["lex"].isNotNull()
            if c.value_url:
                single.append(F.when(there, quad(s_kind, s, p, "iri", iri(c.value_url))).otherwise(none))
            elif c.separator is None:
                single.append(F.when(there, _literal(c, s_kind, s, p, x["lex"], x["ok"])).otherwise(none))
            elif not c.ordered:
                many.append(F.transform(x["lex"], _item_literal(c, s_kind, s, p)))
            else:
                node = _list_node(ordinal, row, j)
                size = F.size(x["lex"])
                empty = size == 0
                single.append(F.when(there, quad(s_kind, s, p, F.when(empty, F.lit("iri")).otherwise(F.lit("bnode")), F.when(empty, F.lit(RDF + "nil")).otherwise(node(F.lit(0))))).otherwise(none))
                many += [F.transform(x["lex"], f) for f in _list_cells(c, node, size)]
        if not options.minimal:
            single.append(F.when(there, quad("bnode", row_node, CSVW + "describes", s_kind, s)).otherwise(none))
    if not options.minimal:
        t_kind, t = table_node(table, ordinal)
        single += [quad(t_kind, F.lit(t), CSVW + "row", "bnode", row_node), quad("bnode", row_node, RDF + "type", "iri", F.lit(CSVW + "Row")), quad("bnode", row_node, CSVW + "rownum", "literal", row, XSD + "integer"),
                   quad("bnode", row_node, CSVW + "url", "iri", F.concat(F.lit(f"{table.url}#row="), source_row))]
        for name in table.row_titles:
            i, c = next((i, c) for i, c in enumerate(physical) if c.name == name)
            lang = None if c.lang == "und" else c.lang
            dt = RDF + "langString" if lang else XSD + "string"
            if c.separator is None:
                single.append(F.when(F.col(f"x{i}.lex").isNotNull(), quad("bnode", row_node, CSVW + "title", "literal", F.col(f"x{i}.lex"), dt, lang)).otherwise(none))
            else:
                many.append(F.transform(F.col(f"x{i}.lex"), _item_title(row_node, dt, lang)))
    empty = F.array().cast("array<struct<" + QUAD.replace(" string", ":string").replace(" ", "") + ">>")
    own = staged.frame()
    # a row's quads are a set; columns that give one quad each, with fixed predicates that all differ, cannot repeat one
    if options.minimal and not many and single and len(set(predicates)) == len(predicates) and not any(templates.variables(x) for x in predicates):
        return own.select(F.inline(F.array(*single))).where("s is not null").select(*QUAD_COLUMNS)
    everything = F.concat(F.array(*single) if single else empty, *[F.coalesce(m, empty) for m in many])
    return own.select(F.inline(F.array_distinct(F.filter(everything, lambda q: q.isNotNull())))).select(*QUAD_COLUMNS)


class Staged:
    """IRIs from templates as columns of their own: computed once a row, however many quads hold them."""

    def __init__(self, df: DataFrame, pretty: bool):
        self.df, self.pretty = df, pretty
        self.names: dict[tuple[str, int], str] = {}
        self.raw: dict[str, C] = {}

    def iri(self, template: str, column: int, make: Callable[[bool], C]) -> C:
        found = templates.variables(template)
        if not found:
            return make(self.pretty)
        key = template, column if {"_name", "_column", "_sourceColumn"} & set(found) else -1
        if key not in self.names:
            self.names[key] = f"iri{len(self.names)}"
            self.raw[self.names[key]] = make(False)
        return F.col(self.names[key])

    def frame(self) -> DataFrame:
        out = self.df.withColumns(self.raw)
        return out.withColumns({n: templates.decode_column(F.col(n)) for n in self.raw}) if self.pretty else out


def table_node(table: Table, ordinal: int) -> tuple[str, str]:
    return ("iri", table.id) if table.id else ("bnode", f"_:t{ordinal}")


def frame_quads(spark: SparkSession, group: TableGroup) -> DataFrame:
    """The quads of group and tables themselves, and of their notes and foreign properties."""
    rows = []
    g_kind, g = ("iri", group.id) if group.id else ("bnode", "_:g")
    add = lambda s_kind, s, p, o_kind, o: rows.append((s_kind, s, p, o_kind, o, None, None, None))
    add(g_kind, g, RDF + "type", "iri", CSVW + "TableGroup")

    def extra(node: str, owner: TableGroup | Table, label: str) -> None:
        for i, note in enumerate(owner.notes):
            rows.extend(external_quads(note, node, CSVW + "note", group.lang, f"{label}n{i}x"))
        for i, (k, v) in enumerate(owner.external.items()):
            rows.extend(external_quads(v, node, k, group.lang, f"{label}e{i}x"))

    extra(g, group, "g")
    for k, t in enumerate(group.tables):
        if t.suppress:
            continue
        t_kind, node = table_node(t, k)
        add(g_kind, g, CSVW + "table", t_kind, node)
        add(t_kind, node, RDF + "type", "iri", CSVW + "Table")
        add(t_kind, node, CSVW + "url", "iri", t.url)
        extra(node, t, f"t{k}")
    return spark.createDataFrame(rows, QUAD)


def convert(spark: SparkSession, group: TableGroup, read: Callable[[Table], tuple[DataFrame, Table]], options: Options = Options()) -> DataFrame:
    """All quads of a table group; ``read`` gives a table's rows and the table as its header completes it."""
    done = None
    full = []
    for k, t in enumerate(group.tables):
        if t.suppress:
            full.append(t)
            continue
        df, t = read(t)
        full.append(t)
        own = row_quads(df, t, k, options)
        done = own if done is None else done.unionByName(own)
    if not options.minimal:
        frame = frame_quads(spark, TableGroup(tuple(full), group.id, group.notes, group.external, group.lang, group.dialect))
        done = frame if done is None else done.unionByName(frame)
    return spark.createDataFrame([], QUAD) if done is None else done


def _bad_cell(warn, c: Column):
    return lambda v: warn(F.concat(F.lit("'"), v["lex"], F.lit(f"' is not a valid {c.datatype.base}")), c)


def cell_issues(df: DataFrame, table: Table) -> DataFrame:
    """A warning for each missing required cell and each cell that its datatype does not allow."""
    own = cells(df, table)
    found = []
    warn = lambda text, c: F.struct(F.lit("warning").alias("type"), text.alias("message"), F.lit(table.url).alias("table"), F.col("_row").cast("bigint").alias("row"), F.lit(c.name).alias("column"))
    for i, c in enumerate(x for x in table.columns if not x.virtual):
        x = F.col(f"x{i}")
        if c.required:
            found.append(F.when(x["lex"].isNull(), F.array(warn(F.lit("a required cell is empty"), c))))
        bad = _bad_cell(warn, c)
        if c.separator is None:
            found.append(F.when(~x["ok"], F.array(bad(x))))
        else:
            found.append(F.transform(F.filter(x["lex"], lambda v: ~v["ok"]), bad))
    if "_cells" in df.columns:
        width = len([c for c in df.columns if re.fullmatch(r"_c\d+", c)])
        text = F.concat(F.lit("the row has "), F.col("_cells").cast("string"), F.lit(f" cells, the table {width}"))
        bad_row = F.struct(F.lit("error").alias("type"), text.alias("message"), F.lit(table.url).alias("table"), F.col("_row").cast("bigint").alias("row"), F.lit(None).cast("string").alias("column"))
        found.append(F.when(F.col("_cells") != width, F.array(bad_row)))
    if not found:
        return df.sparkSession.createDataFrame([], ISSUE)
    kind = "array<struct<" + ISSUE.replace(" string", ":string").replace(" bigint", ":bigint").replace(" ", "") + ">>"
    return own.select(F.inline(F.flatten(F.array(*[F.coalesce(f.cast(kind), F.array().cast(kind)) for f in found]))))


def key_issues(tables: dict[str, tuple[DataFrame, Table]]) -> DataFrame | None:
    """Extension: primary keys that repeat, and foreign keys without a counterpart."""
    out = None

    def keyed(url: str, names: tuple[str, ...]) -> DataFrame:
        df, t = tables[url]
        index = {c.name: i for i, c in enumerate(x for x in t.columns if not x.virtual)}
        return cells(df, t).select("_row", *[F.col(f"x{index[n]}.lex").cast("string").alias(f"k{i}") for i, n in enumerate(names)])

    def add(rows: DataFrame, message: str, url: str, names: tuple[str, ...]) -> None:
        nonlocal out
        own = rows.select(F.lit("error").alias("type"), F.concat(F.lit(message + ": "), F.concat_ws(", ", *[c for c in rows.columns if c.startswith("k")])).alias("message"), F.lit(url).alias("table"), F.col("_row").cast("bigint").alias("row"), F.lit(", ".join(names)).alias("column"))
        out = own if out is None else out.unionByName(own)

    for url, (_, t) in tables.items():
        if t.primary_key:
            k = keyed(url, t.primary_key)
            cols = [c for c in k.columns if c != "_row"]
            add(k.groupBy(*cols).agg(F.min("_row").alias("_row"), F.count("*").alias("n")).where("n > 1"), "a primary key repeats", url, t.primary_key)
        for fk in t.foreign_keys:
            if fk.resource in tables and fk.columns:
                a, b = keyed(url, fk.columns), keyed(fk.resource, fk.referenced).drop("_row")
                cols = [c for c in a.columns if c != "_row"]
                add(a.na.drop(subset=cols).join(b, cols, "left_anti"), "a foreign key has no counterpart", url, fk.columns)
    return out


def validate(spark: SparkSession, group: TableGroup, read: Callable[[Table], tuple[DataFrame, Table]], issues: Issues) -> DataFrame:
    """Metadata issues and cell issues of all tables."""
    out = None
    for t in group.tables:
        if not t.suppress:
            df, full = read(t)
            own = cell_issues(df, full)
            out = own if out is None else out.unionByName(own)
    head = issues.frame(spark)
    return head if out is None else head.unionByName(out)
