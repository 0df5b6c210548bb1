"""Schema inference from quads: one table per class, set at a time, and pure functions that edit the result."""

from __future__ import annotations

import copy
import functools
import os
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.functions.terms import QUAD, RDF, RDFS, SKOS, common_ancestor, datatype_name, local_name
from quadloom.plans.descriptor import percent_name

TYPE = RDF + "type"
#: Names that a descriptor of inferred tables has.
UNTYPED = "unknown_type.csv"
SUBJECT = "subject_id"
LABELS = [SKOS + "prefLabel", RDFS + "label", RDF + "label"]


def classes(quads: DataFrame) -> DataFrame:
    """g, s, class."""
    return quads.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).select("g", "s", F.col("o").alias("class")).distinct()


#: What is known of a subject's values under one predicate, of a class's values under one predicate, or of a class's
#: subjects: smallest and largest value, datatypes, the extremes of IRIs in both reading directions and of their numbers of
#: separators. Every part is a minimum, a maximum or a union, so that parts of the data merge in any order.
FACTS = ["vlo", "vhi", "dts", "lo", "hi", "rlo", "rhi", "smin", "smax", "lang"]
SEPARATOR = "[/?&=#{}]|\\[|\\]"


def _merged(many: Sequence[str] = ()) -> list[Column]:
    """FACTS of rows that hold FACTS."""
    least = ["vlo", "lo", "rlo", "smin"]
    return [(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))) if c == "dts" else F.min(c) if c in least else F.max(c)).alias(c) for c in [*FACTS, *many]]


def observations(quads: DataFrame) -> DataFrame:
    """g, s, p: FACTS of the subject's values, and ``classes``, the values of rdf:type. One aggregate, combined before its
    shuffle; a mergeable state of the data read so far."""
    iri = F.when(F.col("o_kind") == "iri", F.col("o"))
    value, kind = F.struct("o", "o_dt", "o_lang"), F.col("s_kind") == "iri"
    own = quads.select("g", "s", "p", value.alias("vlo"), value.alias("vhi"), F.array(datatype_name(F.col("o_kind"), F.col("o_dt"))).alias("dts"), iri.alias("lo"), iri.alias("hi"), F.reverse(iri).alias("rlo"),
                       F.reverse(iri).alias("rhi"), _separators(iri).alias("smin"), _separators(iri).alias("smax"), F.col("o_lang").alias("lang"), F.when(F.col("p") == TYPE, iri).alias("class"), kind.alias("named"))
    return own.groupBy("g", "s", "p").agg(*_merged(), F.collect_set("class").alias("classes"), F.max("named").alias("named"))


def merge(*states: DataFrame) -> DataFrame:
    """The observations of all states' data together."""
    own = functools.reduce(DataFrame.unionByName, states)
    return own.groupBy("g", "s", "p").agg(*_merged(), F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"), F.max("named").alias("named"))


def summary(state: DataFrame) -> DataFrame:
    """Per class ('' for subjects without one) and predicate: FACTS and whether several values occur; without predicate, of the
    class's IRI subjects. Subjects are brought together with their classes by one aggregate over what is known of each."""
    facts = F.struct("p", *FACTS, (~F.col("vlo").eqNullSafe(F.col("vhi"))).alias("multi"))
    per = state.groupBy("g", "s").agg(F.flatten(F.collect_list("classes")).alias("classes"), F.collect_list(F.when(F.col("p") != TYPE, facts)).alias("facts"), F.max("named").alias("named"))
    s = F.when(F.col("named"), F.col("s"))
    null = F.lit(None)
    value = "struct<o:string,o_dt:string,o_lang:string>"
    itself = F.struct(null.cast("string").alias("p"), null.cast(value).alias("vlo"), null.cast(value).alias("vhi"), F.array().cast("array<string>").alias("dts"), s.alias("lo"), s.alias("hi"), F.reverse(s).alias("rlo"),
                      F.reverse(s).alias("rhi"), _separators(s).alias("smin"), _separators(s).alias("smax"), null.cast("string").alias("lang"), F.lit(False).alias("multi"))
    none = F.array(F.lit(""))
    rows = per.select(F.explode(F.when(F.size("classes") > 0, F.col("classes")).otherwise(none)).alias("class"), F.concat(F.col("facts"), F.array(itself)).alias("facts")).select("class", F.inline("facts"))
    return merge_summaries(rows)


def merge_summaries(rows: DataFrame) -> DataFrame:
    """Rows of summary(), from several parts whose subjects differ or repeat, as one row per class and predicate."""
    return rows.groupBy("class", "p").agg(*_merged(["multi"]))


def _level(rows: DataFrame) -> DataFrame:
    return rows.withColumn("level", F.col("smin") == F.col("smax"))


def columns(quads: DataFrame) -> DataFrame:
    """Per class ('' for subjects without one) and predicate: whether several values occur, datatypes, and the extremes
    of IRI objects, from which templates follow."""
    return _level(summary(observations(quads))).where("p is not null").select("class", "p", "multi", "dts", "lo", "hi", "rlo", "rhi", "level")


def _separators(iri: Column) -> Column:
    """How many characters of an IRI separate its parts: where all have equally many, none lies in what varies, or in all."""
    return F.length(iri) - F.length(F.regexp_replace(iri, SEPARATOR, ""))


def subjects(quads: DataFrame) -> DataFrame:
    """Per class: the extremes of its IRI subjects."""
    return _level(summary(observations(quads))).where("p is null").select("class", "lo", "hi", "rlo", "rhi", "level")


def labels(quads: DataFrame, lang: str = "en") -> DataFrame:
    """iri, label: prefLabel before label, the preferred language before none before others; else the local name."""
    own = quads.where(F.col("p").isin(LABELS) & (F.col("o_kind") == "literal"))
    rank = F.when(F.col("p") == LABELS[0], 0).otherwise(1)
    tongue = F.when(F.lower("o_lang") == lang, 0).when(F.lower("o_lang").startswith(lang + "-"), 1).when(F.col("o_lang").isNull(), 2).otherwise(3)
    best = Window.partitionBy("s").orderBy(tongue, rank, "o")
    return own.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("s").alias("iri"), F.col("o").alias("label"))


def vocabularies(quads: DataFrame) -> list[str]:
    """The namespaces of predicates and classes (a row each), without their last character: where their documents are."""
    used = quads.select(F.col("p").alias("iri")).union(quads.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).select("o")).distinct()
    return sorted(r.ns for r in used.select(F.regexp_extract("iri", r"^(.*)[/#][^/#]*$", 1).alias("ns")).where("ns <> ''").distinct().collect())


def fetch_vocabularies(quads: DataFrame, read: Callable[[str], str]) -> DataFrame | None:
    """The quads of those vocabularies' documents that ``read`` gives; each is asked for once, one that cannot be read or
    parsed is passed over."""
    from quadloom.sources import rdf

    rows: list[tuple] = []
    for i, place in enumerate(vocabularies(quads)):
        try:
            rows += rdf.parse(read(place), place, f"v{i}n")
        except (OSError, KeyError, ValueError):
            continue
    return quads.sparkSession.createDataFrame(rows, QUAD) if rows else None


def template(lo: str | None, hi: str | None, rlo: str | None, rhi: str | None, name: str, level: bool | None = True) -> str | None:
    """prefix{name}suffix of what lies between two extremes in both reading directions; {+name} if the varying part may
    hold a separator or nothing is common. What the extremes share all values share, in both directions; ``level``, whether
    all values have equally many separators, then says of all varying parts what the extremes' show."""
    if lo is None or hi is None:
        return None
    if lo == hi:
        cut = max(lo.rfind("/"), lo.rfind("#")) + 1
        return f"{lo[:cut]}{{{name}}}" if cut and cut < len(lo) and not re.search(SEPARATOR, lo[cut:]) else f"{{+{name}}}"
    prefix = os.path.commonprefix([lo, hi])
    prefix = prefix[: max(prefix.rfind("/"), prefix.rfind("#")) + 1]
    suffix = os.path.commonprefix([rlo or "", rhi or ""])[::-1]
    suffix = suffix[min((i for i in (suffix.find("/"), suffix.find("#")) if i >= 0), default=len(suffix)) :]
    if not level or len(prefix) < 8 or "://" not in prefix or prefix.endswith("://"):
        return f"{{+{name}}}"
    varying = [x[len(prefix) : len(x) - len(suffix) or None] for x in (lo, hi)]
    return f"{{+{name}}}" if any(re.search(SEPARATOR, v) for v in varying) else f"{prefix}{{{name}}}{suffix}"


def infer(quads: DataFrame, vocabulary: DataFrame | None = None, lang: str = "en") -> dict[str, Any]:
    """A descriptor. What reaches the driver is one row per class and per (class, predicate)."""
    every = quads if vocabulary is None else quads.unionByName(vocabulary)
    used = quads.select(F.col("p").alias("iri")).union(quads.where(F.col("p") == TYPE).select("o")).distinct()
    names = {r.iri: r.label for r in labels(every, lang).join(used, "iri").collect()}
    return describe(_level(summary(observations(quads))).collect(), names)


def _local(iri: str) -> str:
    return iri.rstrip("/#").replace("#", "/").rpartition("/")[2] or "x"


def describe(found: Iterable[Row], names: Mapping[str, str] | None = None, group: dict[str, Any] | None = None, lock: bool = False) -> dict[str, Any]:
    """A descriptor from rows of summary() with their ``level``. ``names``: labels of classes and predicates.

    With a ``group`` that was made before, its tables are frozen: a class that has a table keeps it, predicates that it lacks
    go to new tables of two columns, and only new classes get whole tables. ``lock`` makes templates fit whatever comes:
    {+name}."""
    names = names or {}
    rows: dict[str, list] = {}
    extremes = {}
    for r in sorted(found, key=lambda r: (r["class"], r.p or "")):
        if r.p is None:
            extremes[r["class"]] = r
        else:
            rows.setdefault(r["class"], []).append(r)
    tables: list[dict[str, Any]] = copy.deepcopy(group["tables"]) if group else []
    frozen = {_class_of(t): t for t in tables if not t["tableSchema"]["foreignKeys"]}
    related = {(_class_of(t), t["tableSchema"]["columns"][1]["propertyUrl"]) for t in tables if _is_relation(t)}
    taken = {t["url"] for t in tables}

    def url(stem: str) -> str:
        own, n = f"{percent_name(stem)}.csv", 2
        while own in taken:
            own, n = f"{percent_name(stem)}_{n}.csv", n + 1
        taken.add(own)
        return own

    def shape(name: str, e: Any) -> str | None:
        return f"{{+{name}}}" if lock else template(e.lo, e.hi, e.rlo, e.rhi, name, e.level)

    for cls in sorted(extremes, key=lambda c: (c == "", c)):
        own, e = rows.get(cls, []), extremes[cls]
        if cls == "" and not own:
            continue
        key = SUBJECT
        table = frozen.get(cls)
        known = {c.get("propertyUrl") for c in table["tableSchema"]["columns"][1:]} if table else set()
        if table:
            first = table["tableSchema"]["columns"][0]
            about = first["aboutUrl"]
        else:
            about = shape(key, e) or f"{{+{key}}}"
            first = {"name": key, "titles": key, "datatype": "anyURI", "aboutUrl": about}
            if cls:
                first |= {"propertyUrl": "rdf:type", "valueUrl": cls, "required": True}
            new = {"url": url(names.get(cls) or _local(cls)) if cls else UNTYPED, "tableSchema": {"columns": [first], "primaryKey": [key], "foreignKeys": []}}
            tables.append(new)
        target = table or new
        for i, r in enumerate(own):
            if r.p in known or (cls, r.p) in related:
                continue
            name = percent_name(_local(r.p)).replace("%", "_") + str(i)
            dt = common_ancestor(sorted(r.dts))
            col: dict[str, Any] = {"name": name, "titles": names.get(r.p) or _local(r.p), "datatype": dt, "propertyUrl": r.p, "aboutUrl": about}
            if dt == "anyURI" and r.lo is not None:
                col["valueUrl"] = shape(name, r)
            if not r.multi and not table:
                target["tableSchema"]["columns"].append(col)
                continue
            own_key = {k: v for k, v in first.items() if k != "required"}
            tables.append({"url": url(target["url"][:-4] + "_" + _local(r.p)), "tableSchema": {"columns": [own_key, {**col, "required": True}], "primaryKey": [key, name],
                           "foreignKeys": [{"columnReference": key, "reference": {"resource": target["url"], "columnReference": key}}]}})
    return {"@context": "http://www.w3.org/ns/csvw", "tables": tables}


def _class_of(table: dict[str, Any]) -> str:
    return table["tableSchema"]["columns"][0].get("valueUrl", "") if table["tableSchema"]["columns"] else ""


def _is_relation(table: dict[str, Any]) -> bool:
    """Whether it is a class's table for one predicate: two columns, the second with that predicate, and a key to the class's table."""
    return len(table["tableSchema"]["columns"]) == 2 and bool(table["tableSchema"]["foreignKeys"])


def lock(group: dict[str, Any]) -> dict[str, Any]:
    """The descriptor with templates that fit every later IRI: about and value URLs become {+name}, the key's for all columns."""
    out = copy.deepcopy(group)
    for t in out["tables"]:
        cols = t["tableSchema"]["columns"]
        if not cols:
            continue
        cols[0]["aboutUrl"] = f"{{+{cols[0]['name']}}}"
        for c in cols[1:]:
            c["aboutUrl"] = cols[0]["aboutUrl"]
            if c.get("valueUrl"):
                c["valueUrl"] = f"{{+{c['name']}}}"
    return out


# Editing: each function returns a new descriptor.

def _find(group: dict[str, Any], url: str) -> dict[str, Any]:
    t = next((t for t in group["tables"] if t["url"] == url), None)
    if t is None:
        raise KeyError(url)
    return t


def add_table(group: dict[str, Any], url: str) -> dict[str, Any]:
    out = copy.deepcopy(group)
    if any(t["url"] == url for t in out["tables"]):
        raise ValueError(f"{url} exists")
    out["tables"].append({"url": url, "tableSchema": {"columns": [], "primaryKey": [], "foreignKeys": []}})
    return out


def rename_table(group: dict[str, Any], url: str, new: str) -> dict[str, Any]:
    out = copy.deepcopy(group)
    if any(t["url"] == new for t in out["tables"]):
        raise ValueError(f"{new} exists")
    _find(out, url)["url"] = new
    for t in out["tables"]:
        for fk in t["tableSchema"]["foreignKeys"]:
            if fk["reference"]["resource"] == url:
                fk["reference"]["resource"] = new
    return out


def remove_table(group: dict[str, Any], url: str) -> dict[str, Any]:
    if len(group["tables"]) < 2:
        raise ValueError("the last table stays")
    out = copy.deepcopy(group)
    out["tables"].remove(_find(out, url))
    for t in out["tables"]:
        t["tableSchema"]["foreignKeys"] = [fk for fk in t["tableSchema"]["foreignKeys"] if fk["reference"]["resource"] != url]
    return out


def rename_column(group: dict[str, Any], url: str, name: str, title: str) -> dict[str, Any]:
    out = copy.deepcopy(group)
    next(c for c in _find(out, url)["tableSchema"]["columns"] if c["name"] == name)["titles"] = title
    return out


def remove_column(group: dict[str, Any], url: str, name: str) -> dict[str, Any]:
    out = copy.deepcopy(group)
    schema = _find(out, url)["tableSchema"]
    if name in schema["primaryKey"]:
        raise ValueError("a primary key column stays")
    schema["columns"] = [c for c in schema["columns"] if c["name"] != name]
    keep = lambda fk, own: name not in ([fk["columnReference"]] if isinstance(fk["columnReference"], str) else fk["columnReference"]) if own else not (fk["reference"]["resource"] == url and name in ([fk["reference"]["columnReference"]] if isinstance(fk["reference"]["columnReference"], str) else fk["reference"]["columnReference"]))
    for t in out["tables"]:
        t["tableSchema"]["foreignKeys"] = [fk for fk in t["tableSchema"]["foreignKeys"] if keep(fk, t["url"] == url)]
    return out


def set_primary_key(group: dict[str, Any], url: str, names: list[str]) -> dict[str, Any]:
    out = copy.deepcopy(group)
    schema = _find(out, url)["tableSchema"]
    if set(names) - {c["name"] for c in schema["columns"]}:
        raise ValueError("an unknown column")
    schema["primaryKey"] = list(names)
    return out


def move_columns(group: dict[str, Any], url: str, to: str, names: list[str]) -> dict[str, Any]:
    """The columns go to another table with copies of the source's primary key columns; its key takes all of them."""
    out = copy.deepcopy(group)
    source, target = _find(out, url)["tableSchema"], _find(out, to)["tableSchema"]
    moved = [c for c in source["columns"] if c["name"] in names and c["name"] not in source["primaryKey"]]
    keys = [copy.deepcopy(c) for c in source["columns"] if c["name"] in source["primaryKey"] and all(c["name"] != x["name"] for x in target["columns"])]
    target["columns"] += keys + moved
    target["primaryKey"] += [c["name"] for c in keys + moved if c["name"] not in target["primaryKey"]]
    source["columns"] = [c for c in source["columns"] if c not in moved]
    return out


__all__ = ["add_table", "classes", "columns", "describe", "fetch_vocabularies", "infer", "labels", "local_name", "lock", "merge", "merge_summaries", "move_columns", "observations", "remove_column", "remove_table", "rename_column", "rename_table", "set_primary_key", "subjects", "summary", "template", "vocabularies"]
