"""Checks of descriptors, one by one, editing of inferred ones, and where issues are."""

import json

import pytest

from quadloom.functions.terms import is_language_tag
from quadloom.issues import Issues, ValidationError
from quadloom.operators import infer
from quadloom.plans.descriptor import Loader, external_quads
from quadloom.sources import resolve

NS = "http://www.w3.org/ns/csvw"


def table(columns=None, schema=None, **more):
    return {"@context": NS, "url": "t.csv", "tableSchema": {"columns": columns or [{"name": "a"}], **(schema or {})}, **more}


def column(**more):
    return table([{"name": "a", **more}])


def datatype(**more):
    return column(datatype=more)


def reference(**fk):
    return table(schema={"foreignKeys": [{"columnReference": "a", "reference": {"resource": "t.csv", "columnReference": "a"}, **fk}]})


CASES = [
    # identifiers and types
    ({**table(), "@id": 5}, "warning", "@id is not a string"), ({**table(), "@id": "_:x"}, "error", "@id is a blank node"), ({**table(), "@type": "Schema"}, "error", "@type should be Table"),
    (table(schema={"@type": "Nope"}), "error", "unknown @type"), (table(schema={"@type": "Table"}), "error", "@type should be Schema"), (column(**{"@type": "Table"}), "error", "@type should be Column"),
    ({**table(), "@foo": 1}, "error", "unknown keyword"), ({**table(), "dc:title": {"@language": "en"}}, "error", "@language without @value"), ({**table(), "dc:title": {"@value": "x", "@language": "1"}}, "error", "not a language tag"),
    # contexts
    ({**table(), "@context": [NS, {"@language": "not a tag"}]}, "warning", "not a language tag"), ({**table(), "@context": [NS, {"@vocab": "x"}]}, "error", "the context has the key"),
    # groups and tables
    ({"@context": NS, "tables": []}, "error", "needs tables"), ({"@context": NS, "tables": [table(), 7]}, "warning", "a table is not an object"), ({"@context": NS, "tables": [table()], "tableDirection": "up"}, "warning", "tableDirection"),
    ({"@context": NS, "tables": [{"tableSchema": {"columns": []}}]}, "error", "needs a url"), ({**table(), "tableDirection": 3}, "warning", "tableDirection"), ({**table(), "suppressOutput": "yes"}, "warning", "not a boolean"), ({**table(), "notes": "n"}, "warning", "notes"),
    ({**table(), "foo": 1}, "warning", "no property foo"), ({**table(), "transformations": [{"url": "x"}]}, "warning", "a transformation lacks"), ({**table(), "transformations": [{"url": "x", "targetFormat": "y", "scriptFormat": "z", "foo": 1}]}, "warning", "no property foo"),
    # schemas and columns
    ({"@context": NS, "url": "t.csv", "tableSchema": {"columns": "x"}}, "warning", "columns is not an array"), ({"@context": NS, "url": "t.csv", "tableSchema": {"columns": [3]}}, "warning", "a column is not an object"), ({"@context": NS, "url": "t.csv", "tableSchema": 4}, "warning", "an object was expected"),
    (table([{"name": "a"}, {"name": "a"}]), "error", "one name"), (table([{"name": "v", "virtual": True}, {"name": "a"}]), "error", "a virtual column"), (table(schema={"primaryKey": "zz"}), "warning", "primaryKey"), (table(schema={"rowTitles": ["zz"]}), "warning", "rowTitles"),
    (table(schema={"foreignKeys": {}}), "warning", "foreignKeys is not an array"), (column(foo=1), "warning", "no property foo"), (table([{"name": "_a"}]), "warning", "not a column name"), (table([{"name": "a b"}]), "warning", "not a column name"), (column(titles=5), "warning", "titles"),
    (column(titles={"xx1 y": "t"}), "warning", "titles"), (column(titles={"en": [1]}), "warning", "titles"), (column(virtual="no"), "warning", "not a boolean"),
    # foreign keys
    (table(schema={"foreignKeys": [3]}), "error", "needs a reference"), (reference(reference={"resource": "zz.csv", "columnReference": "a"}), "error", "unknown table"), (reference(columnReference="zz"), "error", "unknown column"),
    (reference(reference={"resource": "t.csv", "columnReference": "zz"}), "error", "unknown column"), (reference(foo=1), "error", "has the property foo"), (reference(reference={"schemaReference": "none", "columnReference": "a"}), "error", "unknown table"),
    # dialects
    *[(table(dialect={k: v}), "warning", f"the dialect's {k}") for k, v in (("delimiter", 1), ("delimiter", None), ("quoteChar", 3), ("commentPrefix", False), ("doubleQuote", "x"), ("header", 1), ("skipBlankRows", "x"), ("skipInitialSpace", 0), ("headerRowCount", -1), ("skipColumns", "2"),
                                                                           ("skipRows", True), ("encoding", "ebcdic"), ("lineTerminators", 5), ("lineTerminators", [1]), ("trim", "both"))],
    (table(dialect={"foo": 1}), "warning", "no property foo"), (table(dialect={"@type": "Table"}), "error", "@type should be Dialect"),
    # inherited properties
    *[(column(**{k: v}), "warning", k) for k, v in (("aboutUrl", 3), ("valueUrl", 3), ("propertyUrl", 3), ("lang", "no tag"), ("null", 5), ("ordered", "x"), ("required", 1), ("separator", 2), ("textDirection", "up"), ("default", 7))],
    # datatypes
    (column(datatype=5), "warning", "datatype is neither"), (column(datatype="nope"), "warning", "unknown datatype"), (datatype(**{"@id": "http://www.w3.org/2001/XMLSchema#string"}), "error", "built-in"), (datatype(base="string", length="x"), "warning", "length is not a number"),
    (datatype(base="integer", maxLength=3), "error", "does not go with"), (datatype(base="string", minLength=5, maxLength=3), "error", "contradict"), (datatype(base="string", length=2, minLength=3), "error", "contradict"), (datatype(base="hexBinary", length=4, maxLength=3), "error", "contradict"),
    (datatype(base="string", minimum=3), "error", "does not go with"), (datatype(base="integer", minInclusive=1, minExclusive=0), "error", "inclusive and exclusive"), (datatype(base="integer", maximum=1, maxExclusive=2), "error", "inclusive and exclusive"),
    (datatype(base="integer", minimum=3, maximum=1), "error", "no value"), (datatype(base="decimal", minExclusive=1, maxInclusive=1), "error", "no value"), (datatype(base="integer", minimum="x"), "warning", "not a number"), (datatype(base="date", minimum="2020-13-01"), "warning", "a bound is not a date"),
    (datatype(base="duration", maximum="x"), "warning", "a bound is not a duration"), (datatype(base="boolean", format="Y"), "warning", "boolean format"), (datatype(base="boolean", format="Y|Y"), "warning", "boolean format"), (datatype(base="string", format=3), "warning", "format is not a string"),
]


@pytest.mark.parametrize("made,kind,text", CASES)
def test_each_check(made, kind, text):
    issues = Issues(throw=False)
    Loader("http://ex.org/", {}.__getitem__, issues).load(made)
    assert any(i[0] == kind and text in i[1] for i in issues.items), issues.items
    if kind == "error":
        with pytest.raises(ValidationError):
            Loader("http://ex.org/", {}.__getitem__).load(made)


@pytest.mark.parametrize("made", [table(), column(titles={"en": ["A", "B"], "de": "C"}), column(**{"@type": "Column"}), datatype(base="date", minimum="2020-01-01", maximum="2020-12-31"), datatype(base="string", minLength=1, maxLength=1), reference(), table(dialect={"quoteChar": None, "trim": "start"}),
                                  {**table(), "dc:title": {"@value": "x", "@language": "en"}}, datatype(base="boolean", format="Y|N"), datatype(base="number", format={"pattern": "#0.0", "decimalChar": ","}), table(schema={"primaryKey": ["a"], "rowTitles": "a"})])
def test_right_descriptors_have_no_issue(made):
    issues = Issues()
    Loader("http://ex.org/", {}.__getitem__, issues).load(made)
    assert issues.items == []


def test_issues_have_their_place():
    issues = Issues(throw=False)
    with issues.at(table="t"):
        with issues.at(row=3, column="c"):
            issues.warn("in")
        issues.error("table")
        with issues.at(table="u"):
            issues.warn("other")
    issues.warn("out")
    assert issues.items == [("warning", "in", "t", 3, "c"), ("error", "table", "t", None, None), ("warning", "other", "u", None, None), ("warning", "out", None, None, None)]


def test_language_tags():
    assert all(map(is_language_tag, ("en", "de-CH", "zh-Hant-TW", "x-private", "und"))) and not any(map(is_language_tag, ("", "e", "en_US", "12", "toolongtag1", "en-")))


def test_foreign_properties_become_quads():
    rows = external_quads([{"@id": "http://a/b"}, {"@value": "x", "@language": "en"}, 3, {"dc:title": "y"}], "http://s", "http://p", "fr")
    assert ("http://a/b", "iri") in {(r[4], r[3]) for r in rows} and ("x", "en") in {(r[4], r[6]) for r in rows} and "3" in {r[4] for r in rows}
    inner = [r for r in rows if r[0] == "bnode"]
    assert [(r[2].rpartition("/")[2], r[4]) for r in inner] == [("title", "y")]


# editing


def inferred():
    key = {"name": "subject_id", "titles": "subject_id", "datatype": "anyURI"}
    cols = lambda *names: [dict(key), *({"name": n, "titles": n, "datatype": "string"} for n in names)]
    fk = [{"columnReference": "subject_id", "reference": {"resource": "a.csv", "columnReference": "subject_id"}}]
    return {"tables": [{"url": "a.csv", "tableSchema": {"columns": cols("x", "y"), "primaryKey": ["subject_id"], "foreignKeys": []}}, {"url": "b.csv", "tableSchema": {"columns": cols("z"), "primaryKey": ["subject_id"], "foreignKeys": fk}}]}


def names(group, url):
    return [c["name"] for c in infer._find(group, url)["tableSchema"]["columns"]]


def test_tables_are_added_renamed_and_removed_with_their_keys():
    g = inferred()
    before = json.dumps(g)
    assert names(infer.add_table(g, "c.csv"), "c.csv") == []
    renamed = infer.rename_table(g, "a.csv", "n.csv")
    assert infer._find(renamed, "b.csv")["tableSchema"]["foreignKeys"][0]["reference"]["resource"] == "n.csv"
    removed = infer.remove_table(g, "a.csv")
    assert [t["url"] for t in removed["tables"]] == ["b.csv"] and infer._find(removed, "b.csv")["tableSchema"]["foreignKeys"] == []
    for bad in (lambda: infer.add_table(g, "a.csv"), lambda: infer.rename_table(g, "a.csv", "b.csv"), lambda: infer.remove_table(removed, "b.csv")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        infer.rename_table(g, "zz.csv", "n.csv")
    assert json.dumps(g) == before


def test_columns_are_renamed_removed_and_moved_with_their_keys():
    g = inferred()
    assert infer._find(infer.rename_column(g, "a.csv", "x", "X title"), "a.csv")["tableSchema"]["columns"][1]["titles"] == "X title"
    assert names(infer.remove_column(g, "a.csv", "x"), "a.csv") == ["subject_id", "y"]
    with pytest.raises(ValueError):
        infer.remove_column(g, "a.csv", "subject_id")
    keyed = infer.set_primary_key(g, "a.csv", ["x"])
    assert infer._find(infer.remove_column(keyed, "a.csv", "subject_id"), "b.csv")["tableSchema"]["foreignKeys"] == []
    with pytest.raises(ValueError):
        infer.set_primary_key(g, "a.csv", ["zz"])
    moved = infer.move_columns(infer.add_table(g, "c.csv"), "a.csv", "c.csv", ["y", "subject_id"])
    assert names(moved, "a.csv") == ["subject_id", "x"] and names(moved, "c.csv") == ["subject_id", "y"]
    assert infer._find(moved, "c.csv")["tableSchema"]["primaryKey"] == ["subject_id", "y"]
    again = infer.move_columns(moved, "a.csv", "b.csv", ["x"])
    assert names(again, "b.csv") == ["subject_id", "z", "x"]


# places


def test_link_headers_and_well_known_places():
    link = '<a.json>; rel="describedby"; type="application/csvm+json", <b.json>; rel=describedby; type="text/html", <c.json>; type="application/json"; rel="describedby"'
    assert resolve.link_metadata(link) == "c.json" and resolve.link_metadata("<x>; rel=next") is None
    assert resolve.places("http://h/d/t.csv", "{+url}.json\n\n/all.json") == ["http://h/d/t.csv.json", "http://h/all.json"]
    assert resolve.override("http://h/x/y", [("http://h/", "a/"), ("http://h/x", "b"), ("^https?://h/z", "c")]) == "b/y" and resolve.override("https://h/zz", [("^https?://h/z", "c")]) == "cz"
    seen = []
    cache = resolve.Cache(lambda u: seen.append(u) or u.upper(), {"k": "v"})
    assert (cache["k"], cache["a"], cache["a"]) == ("v", "A", "A") and seen == ["a"]


def test_metadata_that_does_not_describe_the_table_is_passed_over():
    texts = {"http://h/t.csv-metadata.json": json.dumps({"url": "other.csv"}), "http://h/csv-metadata.json": json.dumps({"tables": [{"url": "t.csv"}]})}
    issues = Issues()
    assert resolve.discover("http://h/t.csv", texts.__getitem__, issues=issues)[0] == "http://h/csv-metadata.json"
    assert [i[1] for i in issues.items] == ["http://h/t.csv-metadata.json does not describe http://h/t.csv"]
    assert resolve.discover("http://h/t.csv", {}.__getitem__) is None
