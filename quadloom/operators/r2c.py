"""RDF to tables. A table's columns that share an aboutUrl are a star: one grouped aggregate over (graph, subject) collects
each column's objects under the column's predicate and filters; exploding the lists gives the exact bag of the join.
Stars whose subject is another column's value are joined on it. Required columns come before optional ones."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import runtime
from quadloom.functions import templates, values
from quadloom.functions.terms import RDF, XSD
from quadloom.issues import Issues
from quadloom.operators import infer
from quadloom.plans.descriptor import Column, Table, TableGroup

TYPE = RDF + "type"
TERM = ["o_kind", "o", "o_dt", "o_lang"]
#: A subject with more quads than this in one star is converted by joins.
HUB = 100_000


@dataclass
class Slot:
    """A column's place in a star."""

    index: int
    column: Column
    predicate: str | None  # None: any predicate that the template gives
    constant: str | None = None  # a fixed object
    text: str | None = None  # the fixed object's text as a literal
    child: str | None = None  # the star that starts at the object


@dataclass
class Star:
    key: str  # the subject's template
    slots: list[Slot] = field(default_factory=list)


def _fold(template: str, table: Table, column: Column, index: int) -> str:
    """A template with the column's own constants filled in."""
    for k, v in (("_name", column.name or ""), ("_column", str(index + 1)), ("_sourceColumn", str(index + 1 + table.dialect.skip_columns))):
        template = re.sub(r"\{([#+]?)" + k + r"\}", lambda m, v=v: ("#" if m[1] == "#" else "") + v, template)
    return template


def _constant_iri(template: str, table: Table) -> str | None:
    if templates.variables(template):
        return None
    from quadloom.functions.terms import expand_iri

    text = expand_iri(template)
    return templates.beautify(templates.normalise_url(text)) if templates.is_absolute(text) else table.url + text


def _shows_subject(c: Column, table: Table) -> bool:
    """In tables inferred for subjects without a class the key has no predicate: it is the subject."""
    name = re.sub(r"[?#].*$", "", table.url).rpartition("/")[2]
    return c.name == infer.SUBJECT and not c.property_url and not c.virtual and name.startswith(infer.UNTYPED[:-4]) and name.endswith(".csv")


def plan(table: Table) -> dict[str, Star]:
    stars: dict[str, Star] = {}
    for i, c in enumerate(table.columns):
        if c.suppress or c.virtual and not c.value_url or _shows_subject(c, table):
            continue
        key = c.about_url or ""
        prop = _fold(c.property_url, table, c, i) if c.property_url else None
        predicate = f"{table.url}#{c.name}" if prop is None else _constant_iri(prop, table)
        value = _fold(c.value_url, table, c, i) if c.value_url else None
        stars.setdefault(key, Star(key)).slots.append(Slot(i, c, predicate, _constant_iri(value, table) if value is not None else None, value))
    for star in stars.values():
        for slot in star.slots:
            if slot.column.value_url and slot.column.value_url in stars and slot.column.value_url != star.key:
                slot.child = slot.column.value_url
    return stars


def is_type(slot: Slot) -> bool:
    """Whether the column says that the subject is of a fixed class."""
    return slot.constant is not None and slot.predicate == TYPE


def needed(star: Star, table: Table) -> list[Slot]:
    return [s for s in star.slots if s.column.required or s.column.name in table.primary_key]


def matches(slot: Slot, table: Table) -> C:
    """Whether a quad is a value of the column."""
    c = slot.column
    ok = F.col("p") == slot.predicate if slot.predicate else F.lit(True)
    if c.value_url:
        if slot.constant is None:
            ok = ok & F.col("o_kind").isin("iri", "bnode")
        else:  # the constant itself, or a literal of the column's datatype or language with the template's text
            same = (F.col("o_kind") == "iri") & (F.col("o") == slot.constant)
            if not is_type(slot):
                same = same | (F.col("o_kind") == "literal") & (F.col("o") == slot.text) & _typed(c)
            ok = ok & same
        if slot.constant is None and slot.child is None:
            ok = ok & F.col("o").rlike(templates.like(c.value_url, table.url)[0])
    else:
        ok = ok & values.satisfies(F.col("o"), c.datatype)
        if c.lang != "und" and c.datatype.uri == XSD + "string":
            ok = ok & _language(c.lang)
    return ok


def _language(lang: str) -> C:
    low = lang.lower()
    return F.coalesce((F.lower("o_lang") == low) | F.lower("o_lang").startswith(low + "-"), F.lit(False))


def _typed(column: Column) -> C:
    if column.datatype.uri == XSD + "string":
        return _language(column.lang) if column.lang != "und" else F.col("o_lang").isNull() & (F.coalesce("o_dt", F.lit(XSD + "string")) == XSD + "string")
    return F.coalesce(F.col("o_dt") == column.datatype.uri, F.lit(False))


def in_graphs(quads: DataFrame) -> DataFrame:
    """The default graph has the name '', so that graphs compare as plain text."""
    return quads.withColumn("g", F.coalesce("g", F.lit("")))


def of_star(quads: DataFrame, star: Star, table: Table) -> DataFrame:
    """The quads that can belong to a star, by predicate and subject."""
    own = quads
    predicates = {s.predicate for s in star.slots}
    if None not in predicates:
        own = own.where(F.col("p").isin(sorted(predicates)))  # reaches the scan
    if star.key:
        regex, prefix = templates.like(star.key, table.url)
        if prefix:
            own = own.where(F.col("s").startswith(prefix))
        own = own.where((F.col("s_kind") == "iri") & F.col("s").rlike(regex))
    return own


def _reduced(own: DataFrame, star: Star, table: Table) -> DataFrame:
    """Quads of subjects that have the star's constants: a class, or a value that a needed column fixes. The semi-join stands
    below the aggregate and shares its partitioning; small seeds are broadcast, larger ones filter the scan at run time."""
    for slot in star.slots:
        if is_type(slot) or slot.constant is not None and slot in needed(star, table):
            seeds = own.where(matches(slot, table)).select(F.col("g").alias("seed_g"), F.col("s").alias("seed_s"))
            own = own.join(seeds, (F.col("s") == F.col("seed_s")) & (F.col("g") == F.col("seed_g")), "left_semi")
    return own


def star_lists(quads: DataFrame, star: Star, table: Table, distinct: bool = False) -> DataFrame:
    """g, subject and the list l{i} of each column's objects: one shuffle on (g, s)."""
    return _lists(_reduced(of_star(quads, star, table), star, table), star, table, distinct)


def _faceted(slot: Slot) -> bool:
    dt = slot.column.datatype
    return bool(dt.bounds or dt.format or dt.length is not None or dt.min_length is not None or dt.max_length is not None)


def _lists(own: DataFrame, star: Star, table: Table, distinct: bool) -> DataFrame:
    if any(_faceted(s) for s in star.slots):  # values outside their facets do not cross the shuffle
        own = own.where(_any([matches(s, table) for s in star.slots]))
    if distinct:  # each quad once, by the aggregate that is needed anyway
        lists = [F.collect_set(F.when(matches(s, table), F.struct(*TERM, *(["p"] if s.predicate is None else [])))).alias(f"l{s.index}") for s in star.slots]
    else:
        lists = [F.collect_list(F.when(matches(s, table), F.col("o"))).alias(f"l{s.index}") for s in star.slots]
    out = own.groupBy("g", "s").agg(*lists)
    if distinct:
        out = out.select("g", "s", *[F.col(f"l{s.index}.o").alias(f"l{s.index}") for s in star.slots])
    must = [s for s in star.slots if s in needed(star, table) or is_type(s)]
    if not needed(star, table):  # all optional: a subject counts once any column has a value
        out = out.where(_any([F.size(f"l{s.index}") > 0 for s in star.slots]))
    for s in must:
        out = out.where(F.size(f"l{s.index}") > 0)
    return out


def _any(tests: list[C]) -> C:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


class Hubs:
    """The subjects of a star that have more than ``limit`` quads, and their values as rows: no list holds them, and no task
    has all of one. Their values are found in one pass, each once, and written. Columns are crossed over a grid of lines and
    columns: a left row goes to one line and all columns of it, a value of the next column to one column and all lines, so
    that each pair meets once. A subject's grid follows from the numbers of its rows and values: a side of few is repeated,
    the other is not, and it has a cell for every CELL pairs, CELLS at least."""

    CELLS, CELL, MOST = 64, 1_000_000, 1 << 14

    def __init__(self, own: DataFrame, star: Star, table: Table, limit: int, distinct: bool):
        self.star, self.table, self.distinct = star, table, distinct
        keys = own.groupBy("g", "s").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("g", "s")
        self.keys = runtime.materialize(keys, "hubs")
        self.found = not self.keys.isEmpty()
        self.own = own
        if self.found:
            matched = F.array_compact(F.array(*[F.when(matches(s, table), F.lit(s.index)) for s in star.slots]))
            every = self._join(own, "left_semi").select("g", "s", "p", *TERM, matched.alias("slots")).where(F.size("slots") > 0)
            every = every.dropDuplicates(["g", "s", "p", *TERM]) if distinct else every
            self.every = runtime.materialize(every.select("g", "s", "o", "slots"), "hub-values")
            counts = self.every.groupBy("g", "s").agg(*[F.count_if(F.array_contains("slots", s.index)).alias(f"n{s.index}") for s in star.slots])
            self.counts = runtime.materialize(counts, "hub-counts")

    def _join(self, quads: DataFrame, how: str) -> DataFrame:
        keys = self.keys.withColumnsRenamed({"g": "hub_g", "s": "hub_s"})  # written: small ones are broadcast, others are not
        return quads.join(keys, (F.col("s") == F.col("hub_s")) & (F.col("g") == F.col("hub_g")), how)

    def others(self) -> DataFrame:
        return self._join(self.own, "left_anti")

    def values(self, slot: Slot) -> DataFrame:
        return self.every.where(F.array_contains("slots", slot.index)).select("g", "s", F.col("o").alias(f"o{slot.index}"))

    def _grid(self, slot: Slot, bound: list[Slot]) -> DataFrame:
        """own_g, own_s, lines and columns, powers of two, for subjects with values of the column."""
        rows = F.lit(1.0)
        for s in bound:
            rows = rows * F.greatest(F.lit(1), f"n{s.index}")
        n = F.col(f"n{slot.index}")
        cells = F.least(F.lit(float(self.MOST)), F.greatest(F.lit(float(self.CELLS)), rows * n / self.CELL))
        power = lambda c: F.pow(F.lit(2.0), F.round(F.log2(c)))
        # rows * columns + n * lines is least where lines / columns is rows / n
        lines = power(F.greatest(F.lit(1.0), F.least(cells, F.sqrt(cells * rows / n))))
        return self.counts.where(n > 0).select(F.col("g").alias("own_g"), F.col("s").alias("own_s"), lines.cast("int").alias("lines"), F.greatest(F.lit(1), power(cells / lines)).cast("int").alias("columns"))

    def rows(self, left_out: list[Slot]) -> DataFrame:
        """g, s and l{i} with at most one value each, a row for each solution; columns ``left_out`` stay empty."""
        must = [s for s in self.star.slots if s in needed(self.star, self.table) or is_type(s)]
        out = self.counts.select("g", "s")
        bound: list[Slot] = []
        for slot in self.star.slots:
            o = f"o{slot.index}"
            if slot in left_out:
                out = out.withColumn(o, F.lit(None).cast("string"))
                continue
            if not bound:  # a row a subject so far
                nulls = [F.lit(None).cast("string").alias(c) for c in out.columns[2:]]
                met = self.values(slot).select("g", "s", *nulls, o)
                if slot not in must:
                    without = self.counts.where(F.col(f"n{slot.index}") == 0)
                    met = met.unionByName(without.select("g", "s", *nulls, F.lit(None).cast("string").alias(o)))
                out = met
                bound.append(slot)
                continue
            grid, values_ = self._grid(slot, bound), [f"o{s.index}" for s in bound]
            line, column = (F.pmod(F.xxhash64(F.lit(kind), *cols), F.col(n)).cast("int") for kind, cols, n in (("line", values_, "lines"), ("column", [o], "columns")))
            dealt = lambda df, how="inner", grid=grid: df.join(F.broadcast(grid), (df["g"] == grid["own_g"]) & (df["s"] == grid["own_s"]), how)
            cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            left = dealt(out).select("g", "s", *out.columns[2:], line.alias("line"), cells("columns").alias("column"))
            right = dealt(self.values(slot)).select("own_g", "own_s", o, column.alias("own_column"), cells("lines").alias("own_line"))
            met = left.join(right, (left["g"] == right["own_g"]) & (left["s"] == right["own_s"]) & (left["line"] == right["own_line"]) & (left["column"] == right["own_column"]))
            met = met.select(*out.columns, o)
            if slot not in must:
                met = met.unionByName(dealt(out, "left_anti").withColumn(o, F.lit(None).cast("string")))
            out = met
            bound.append(slot)
        one = lambda o: F.when(o.isNull(), F.array().cast("array<string>")).otherwise(F.array(o))
        return out.select("g", "s", *[one(F.col(f"o{s.index}")).alias(f"l{s.index}") for s in self.star.slots])


def shared_variables(stars: dict[str, Star], joined: set[str], key: str) -> tuple[str, list[str]]:
    """The joined star whose template shares most variables with that of ``key``, and these variables."""
    common = lambda k: sorted(set(templates.variables(key)) & set(templates.variables(k)))
    found = max((k for k in stars if k in joined), key=lambda k: len(common(k)))
    return found, common(found)


def variable_parts(subject: C, key: str, names: list[str], table: Table) -> C:
    return F.array(*[F.regexp_extract(subject, templates.inverse(key, table.url, v) or "^$", 1) for v in names])


def star_order(stars: dict[str, Star], table: Table) -> list[str]:
    """Where the table begins: at the star of its primary key, then at stars that no value links, then (in cycles) anywhere."""
    children = {s.child for star in stars.values() for s in star.slots if s.child}
    keyed = [k for k, star in stars.items() if any(s.column.name in table.primary_key for s in star.slots)]
    free = [k for k in stars if k not in children]
    return list(dict.fromkeys([*keyed[:1], *free, *stars]))


def subject_of(stars: dict[str, Star], key: str) -> str:
    return f"s{stars[key].slots[0].index}"


def bindings(quads: DataFrame, table: Table, hubs: int | None = None, product: bool = False, distinct: bool = False) -> DataFrame:
    """One row per solution: o{i}, and s{i}, the subject of each column's star; g, the graph ('' the default one).

    Subjects with more than ``hubs`` quads are looked for and converted by joins (None: all are lists). Stars that neither a
    link nor a shared variable joins are an error, unless their ``product`` is asked for. Quads must be a set, or ``distinct``
    makes them one, star by star."""
    stars = plan(table)
    quads = in_graphs(quads)
    done: set[str] = set()
    joined: set[str] = set()  # stars of trees that are complete
    back: list[tuple[Slot, bool]] = []  # links to stars that the tree holds already

    def build(key: str) -> DataFrame:
        done.add(key)
        star = stars[key]
        must = needed(star, table)
        links = [s for s in star.slots if s.child and s.child not in done]
        closing = [s for s in star.slots if s.child and s.child in done and s.child not in joined]
        done.update(s.child for s in links)
        loose = [s for s in links if s not in must and needed(stars[s.child], table)]
        own = _reduced(of_star(quads, star, table), star, table)
        hub = Hubs(own, star, table, hubs, distinct) if hubs is not None else None
        if hub is not None and not hub.found:
            hub = None
        lists = _lists(hub.others() if hub else own, star, table, distinct)
        out = lists.unionByName(hub.rows([*loose, *closing])) if hub else lists
        for s in links:
            right = build(s.child).withColumnsRenamed({"s": "child_s", "g": "child_g"})
            o = f"o{s.index}"
            if s not in loose:
                out = out.withColumn(o, F.explode_outer(f"l{s.index}")).drop(f"l{s.index}")
                how = "inner" if needed(stars[s.child], table) else "left"
                out = out.join(right, (out[o] == right["child_s"]) & (out["g"] == right["child_g"]), how).drop("child_s", "child_g")
                continue
            # an optional link counts only together with what its target must have; without any, the row stays
            pairs = lists.select("g", "s", F.explode(f"l{s.index}").alias(o))
            pairs = (pairs.unionByName(hub.values(s)) if hub else pairs).withColumnsRenamed({"g": "link_g", "s": "link_s"})
            pairs = pairs.join(right, (pairs[o] == right["child_s"]) & (pairs["link_g"] == right["child_g"])).drop("child_s", "child_g")
            out = out.drop(f"l{s.index}")
            out = out.join(pairs, (out["g"] == pairs["link_g"]) & (out["s"] == pairs["link_s"]), "left").drop("link_g", "link_s")
        for s in closing:
            back.append((s, s in must))
        for s in sorted((s for s in star.slots if s not in links and s not in closing), key=lambda s: s not in must):
            out = out.withColumn(f"o{s.index}", F.explode_outer(f"l{s.index}")).drop(f"l{s.index}")
        return out.withColumns({f"s{s.index}": F.col("s") for s in star.slots})

    out = None
    for key in star_order(stars, table):
        if key in done:
            continue
        right = build(key)
        if out is None:
            out, joined = right, set(done)
            continue
        right = right.withColumnsRenamed({"s": "other_s", "g": "other_g"})
        same = F.col("g") == F.col("other_g")
        link = next((s for s in stars[key].slots if s.child in joined), None)
        if link:  # it points at a star that the table begins with: that star's rows stay without it, unless the link is needed
            on = F.col(subject_of(stars, link.child)) == F.col(f"o{link.index}")
            out = out.join(right, same & on, "inner" if link in needed(stars[key], table) else "left")
        else:
            # subjects that no value links: they belong together where their templates' variables agree
            left_key, shared = shared_variables(stars, joined, key)
            if not shared and not product:
                raise ValueError(f"nothing joins {key} to the other subjects of {table.url}")
            on = variable_parts(F.col(subject_of(stars, left_key)), left_key, shared, table) == variable_parts(F.col("other_s"), key, shared, table) if shared else F.lit(True)
            out = out.join(right, same & on, "inner")
        out, joined = out.drop("other_s", "other_g"), set(done)
    for s, must in back:  # the value is the subject that it leads back to
        target = F.col(subject_of(stars, s.child))
        if must:
            out = out.where(F.array_contains(f"l{s.index}", target))
        out = out.withColumn(f"o{s.index}", target).drop(f"l{s.index}")
    return out


def output_names(table: Table, lang: str = "und") -> list[str]:
    """Titles, else names; equal ones are numbered."""
    out: list[str] = []
    for i, c in enumerate(x for x in table.columns if not x.virtual):
        name = c.title(lang) or c.name or f"_col.{i + 1}"
        n, own = 2, name
        while own in out:
            own, n = f"{name} {n}", n + 1
        out.append(own)
    return out


def table_rows(quads: DataFrame, table: Table, lang: str = "und", hubs: int | None = None, product: bool = False, distinct: bool = False) -> DataFrame:
    """The table's text rows. Quads must be a set (sources.rdf.as_set), or ``distinct`` makes them one without a shuffle of its own."""
    return render(bindings(quads, table, hubs, product, distinct), table, lang)


def render(found: DataFrame, table: Table, lang: str = "und", extra: Sequence[C] = ()) -> DataFrame:
    """Solutions as text rows, with columns ``extra`` behind them."""
    cols = []
    physical = [(i, c) for i, c in enumerate(table.columns) if not c.virtual]
    for (i, c), title in zip(physical, output_names(table, lang), strict=True):
        null = c.null[0] if c.null else ""
        star = next((f"s{j}" for j, x in enumerate(table.columns) if x.about_url == c.about_url and f"s{j}" in found.columns), None)
        if _shows_subject(c, table) and star and not c.suppress:
            text = F.col(star) if not c.about_url else _untemplate(F.col(star), c.about_url, table, c.name)
            cols.append(F.coalesce(text, F.lit(null)).alias(title))
            continue
        if c.suppress or f"o{i}" not in found.columns:
            cols.append(F.lit(null).alias(title))
            continue
        text = F.col(f"o{i}")
        if c.property_url and _constant_iri(_fold(c.property_url, table, c, i), table) == TYPE and c.about_url and c.name in templates.variables(c.about_url):
            text = F.when(text.isNotNull(), _untemplate(F.col(f"s{i}"), c.about_url, table, c.name))
        elif c.value_url:
            text = _untemplate(text, c.value_url, table, c.name)
        else:
            text = values.render(text, c.datatype)
        cols.append(F.coalesce(text, F.lit(null)).alias(title))
    return found.select(*cols, *extra)


def _untemplate(iri: C, template: str, table: Table, name: str) -> C:
    regex = templates.inverse(template, table.url, name)
    if not regex:
        return iri
    value = F.regexp_extract(iri, regex, 1)
    return F.when(iri.isNull(), iri).when(iri.rlike(regex), F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)).otherwise(iri)


EXTRACTION_ISSUE = "type string, message string, table string, graph string, subject string, column string, value string"


def extraction_issues(quads: DataFrame, table: Table) -> DataFrame:
    """Warnings of the table's extraction, where they come from: values that their column's facets leave out, and values that
    are shown as they are since its format has no place for them. One pass over the star's quads, without a shuffle."""
    out = None
    for star in plan(table).values():
        found = []
        for slot in star.slots:
            c = slot.column
            if c.value_url or c.suppress:
                continue
            own = (F.col("p") == slot.predicate) & (F.col("o_kind") == "literal")
            inside = values.satisfies(F.col("o"), c.datatype)
            issue = lambda text, c=c: F.struct(F.lit("warning").alias("type"), F.lit(text).alias("message"), F.lit(table.url).alias("table"), F.col("g").alias("graph"), F.col("s").alias("subject"), F.lit(c.name).alias("column"), F.col("o").alias("value"))
            found.append(F.when(own & ~inside, issue(f"the value is left out: it does not meet the facets of {c.datatype.base}")))
            found.append(F.when(own & inside & ~values.displayable(F.col("o"), c.datatype), issue(f"the value is shown as it is: it is no {c.datatype.base} of the format")))
        if found:
            own = of_star(quads, star, table).select(F.inline(F.array_compact(F.array(*found))))
            out = own if out is None else out.unionByName(own)
    return quads.sparkSession.createDataFrame([], EXTRACTION_ISSUE) if out is None else out


def tables_with_rows(group: TableGroup, issues: Issues | None = None) -> list[Table]:
    """The group's tables that are extracted; those without columns and those suppressed are skipped with a warning."""
    out = []
    for t in group.tables:
        empty = all(c.virtual for c in t.columns)
        if not empty and not t.suppress:
            out.append(t)
        elif issues:
            with issues.at(table=t.url):
                issues.warn("the table is skipped: " + ("it has no columns" if empty else "its output is suppressed"))
    return out


def convert(quads: DataFrame, group: TableGroup, issues: Issues | None = None, hubs: int | None = HUB, distinct: bool = False) -> dict[str, DataFrame]:
    """Table URL -> rows, for all tables that are not suppressed and have columns. ``distinct``: quads may repeat."""
    return {t.url: table_rows(quads, t, group.lang, hubs, distinct=distinct) for t in tables_with_rows(group, issues)}
