"""The public functions, their options, the command line, and what is written and checked beside conversions."""

import json

import pytest
from pyspark.sql import functions as F

import quadloom
from quadloom import api, cli
from quadloom.functions import dates, values
from quadloom.functions.terms import QUAD, QUAD_COLUMNS, RDFS, XSD
from quadloom.issues import Issues, ValidationError
from quadloom.operators import r2c, serialize
from quadloom.plans.descriptor import Loader
from quadloom.sources import rdf

B = "http://example.org/"


def lit(s, p, o, dt=XSD + "string", lang=None):
    return ("iri", B + s, B + p, "literal", o, dt, lang, None)


def test_public_names_exist():
    assert all(callable(getattr(quadloom, n)) for n in quadloom.__all__)
    with pytest.raises(AttributeError):
        quadloom.nothing


def test_tables_to_quads_and_back_by_options(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1,one\n2,two é\n")
    made = {"@context": "http://www.w3.org/ns/csvw", "url": "t.csv", "tableSchema": {"aboutUrl": B + "t/{v}", "columns": [{"name": "k", "datatype": "integer"}, {"name": "v"}]}}
    (tmp_path / "t.csv-metadata.json").write_text(json.dumps(made))
    place = str(tmp_path / "t.csv")
    full, lean = (quadloom.to_quads(spark, place, api.ConversionOptions(minimal=m)) for m in (False, True))
    assert lean.count() == 4 and full.count() > 12
    assert {r.s for r in lean.collect()} == {B + "t/one", B + "t/two%20é"}
    kept = quadloom.to_quads(spark, place, api.ConversionOptions(minimal=True, template_iris=False))
    assert {r.s for r in kept.collect()} == {B + "t/one", B + "t/two%20%C3%A9"}
    options = api.ConversionOptions(descriptor=json.dumps(made), base_iri=str(tmp_path) + "/", minimal=True)
    again = quadloom.to_quads(spark, None, options)
    assert sorted(r.o for r in again.collect()) == ["1", "2", "one", "two é"]
    found, tables, inferred = quadloom.to_tables(lean, api.ConversionOptions(descriptor=str(tmp_path / "t.csv-metadata.json")))
    (rows,) = found.values()
    assert sorted(map(tuple, rows.collect())) == [("1", "one"), ("2", "two é")] and inferred is None
    assert quadloom.table_header(next(iter(tables.values())))[1] == ["k", "v"]


def test_places_are_overridden_and_texts_read_once(spark, tmp_path):
    (tmp_path / "real.csv").write_text("k\n1\n")
    seen = []

    def read(url):
        seen.append(url)
        if url == "meta.json":
            return json.dumps({"@context": "http://www.w3.org/ns/csvw", "url": "far.csv", "tableSchema": {"columns": [{"name": "k"}]}})
        raise OSError(url)

    options = api.ConversionOptions(descriptor="meta.json", path_overrides=(("far", str(tmp_path / "real")),), resolve=read, minimal=True)
    assert [r.o for r in quadloom.to_quads(spark, None, options).collect()] == ["1"]
    assert seen == ["meta.json"]
    with pytest.raises(ValueError):
        api.load_group(None, api.ConversionOptions(), Issues())


def test_inferred_names_come_from_labels_if_wanted(spark):
    rows = [("iri", B + "s/1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri", B + "K", None, None, None), lit("s/1", "p", "x"), ("iri", B + "K", RDFS + "label", "literal", "Kind", XSD + "string", None, None)]
    q = spark.createDataFrame(rows, QUAD)
    urls = lambda **kw: {t["url"] for t in api.infer_descriptor(q, api.ConversionOptions(**kw))["tables"]}
    assert "Kind.csv" in urls() and "K.csv" in urls(use_vocab_metadata=False)
    messages = []
    found, _, made = quadloom.to_tables(q, api.ConversionOptions(log_level=api.DEBUG, log=lambda level, text: messages.append(level)))
    assert made and set(found) and messages == [api.DEBUG]


def test_names_come_from_the_documents_of_vocabularies(spark):
    rows = [("iri", B + "s/1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri", "http://voc.org/v#K", None, None, None), ("iri", B + "s/1", "http://voc.org/v#p", "literal", "x", XSD + "string", None, None), lit("s/1", "q", "y")]
    asked = []

    def read(url):
        asked.append(url)
        if url == "http://voc.org/v":
            return '<http://voc.org/v#K> <http://www.w3.org/2004/02/skos/core#prefLabel> "Kind"@en, "Art"@de . <http://voc.org/v#p> <http://www.w3.org/2000/01/rdf-schema#label> "property" .'
        if url == "http://example.org":
            return "this is no RDF <"
        raise OSError(url)

    made = api.infer_descriptor(spark.createDataFrame(rows, QUAD), api.ConversionOptions(resolve=read))
    assert sorted(asked) == ["http://example.org", "http://voc.org/v", "http://www.w3.org/1999/02/22-rdf-syntax-ns"]
    assert [t["url"] for t in made["tables"]] == ["Kind.csv"] and {c["titles"] for c in made["tables"][0]["tableSchema"]["columns"]} == {"subject_id", "property", "q"}


def test_a_sites_list_of_places_is_read(spark):
    texts = {"http://h/.well-known/csvm": "{+url}.meta\n", "http://h/t.csv.meta": json.dumps({"@context": "http://www.w3.org/ns/csvw", "url": "t.csv", "tableSchema": {"columns": [{"name": "own"}]}})}
    g = api.load_group("http://h/t.csv", api.ConversionOptions(resolve=texts.__getitem__), Issues())
    assert g.tables[0].columns[0].name == "own"
    linked = {"http://h/far.json": texts["http://h/t.csv.meta"]}
    g = api.load_group("http://h/t.csv", api.ConversionOptions(resolve=linked.__getitem__, link='<far.json>; rel="describedby"; type="application/csvm+json"'), Issues())
    assert g.tables[0].columns[0].name == "own"


def test_warnings_reach_the_log_by_level(spark):
    g = {"@context": "http://www.w3.org/ns/csvw", "tables": [{"url": "a.csv", "suppressOutput": True, "tableSchema": {"columns": [{"name": "a"}]}}, {"url": "b.csv", "tableSchema": {"columns": [{"name": "b"}]}}]}
    for level, n in ((api.WARN, 1), (api.ERROR, 0)):
        messages = []
        quadloom.to_tables(spark.createDataFrame([], QUAD), api.ConversionOptions(descriptor=g, base_iri=B, log_level=level, log=lambda kind, text, m=messages: m.append(text)))
        assert len(messages) == n


def test_windows_by_option(spark):
    rows = [(*lit(f"t/{n}", "v", str(n)), n) for n in range(25)]
    g = {"@context": "http://www.w3.org/ns/csvw", "url": "t.csv", "tableSchema": {"aboutUrl": B + "t/{k}", "columns": [{"name": "v", "propertyUrl": B + "v"}]}}
    found, _, _ = quadloom.to_tables(spark.createDataFrame(rows, QUAD + ", n bigint"), api.ConversionOptions(descriptor=g, base_iri=B, window_size=10))
    (out,) = found.values()
    assert sorted((r.window, int(r.v)) for r in out.collect()) == sorted((w, n) for w in range(25) for n in range(25) if w <= n < w + 10)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("k,v\n1,one\n2,\n")
    made = {"@context": "http://www.w3.org/ns/csvw", "url": "t.csv", "tableSchema": {"aboutUrl": B + "t/{k}", "columns": [{"name": "k", "datatype": "integer"}, {"name": "v", "required": True}]}}
    (tmp_path / "t.csv-metadata.json").write_text(json.dumps(made))
    assert cli.main(["c2r", str(tmp_path / "t.csv"), "-o", str(tmp_path / "t.nq"), "--minimal"]) == 0
    assert rdf.read_rdf(spark, str(tmp_path / "t.nq")).count() == 3
    assert cli.main(["validate", str(tmp_path / "t.csv")]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["message"] for x in lines] == ["a required cell is empty"]
    assert cli.main(["r2c", str(tmp_path / "t.nq"), "-o", str(tmp_path / "out"), "--descriptor", str(tmp_path / "t.csv-metadata.json")]) == 0
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "t.csv")).collect()) == ["1,one", "k,v"]
    assert cli.main(["r2c", str(tmp_path / "t.nq"), "-o", str(tmp_path / "own"), "--no-vocab-metadata"]) == 0
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "own" / "descriptor.json")).collect())
    assert json.loads(text)["tables"][0]["url"] == "unknown_type.csv"


def test_odd_characters_of_iris_are_escaped_and_read_back(spark):
    rows = [("iri", 'http://a/x y<>"{}|^`\\', "http://a/p q", "literal", "v", "http://a/d t", None, "http://a/g h"), ("iri", "http://a/x", "http://a/é", "iri", "http://a/\x01", None, None, None)]
    q = spark.createDataFrame(rows, QUAD)
    lines = serialize.lines(q)
    assert "<http://a/x\\u0020y\\u003C\\u003E\\u0022\\u007B\\u007D\\u007C\\u005E\\u0060\\u005C>" in lines.collect()[0].value
    assert sorted(map(tuple, rdf.parse_nquads(lines).select(*QUAD_COLUMNS).collect())) == sorted(rows)


def test_midnight_is_the_only_time_of_hour_24(spark):
    texts = ["24:00:00", "24:00:00.0", "24:30:00", "24:00:01", "23:59:59", "23:60:00", "12:00:60"]
    ok = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.check(F.col("t"), "time")[0]).collect()
    assert [r[0] for r in ok] == [True, True, False, False, True, False, False]


@pytest.mark.parametrize("base,low,high,bad", [("date", "2020-01-02", "2020-01-01", True), ("date", "2020-01-01", "2020-01-02", False), ("dateTime", "2020-01-01T00:00:00Z", "2020-01-01T00:30:00+01:00", True),
                                               ("time", "10:00:00", "09:00:00", True), ("duration", "P1M", "P30D", True), ("duration", "P1D", "PT25H", False), ("dayTimeDuration", "-PT1H", "-PT2H", True)])
def test_contradictory_bounds_are_an_error(base, low, high, bad):
    issues = Issues(throw=False)
    Loader(B, issues=issues).load({"@context": "http://www.w3.org/ns/csvw", "url": "t.csv", "tableSchema": {"columns": [{"name": "a", "datatype": {"base": base, "minimum": low, "maximum": high}}]}})
    assert any(i[0] == "error" and "no value" in i[1] for i in issues.items) == bad
    if not bad:
        with pytest.raises(ValidationError):
            Loader(B).load({"@context": "http://www.w3.org/ns/csvw", "url": "t.csv", "tableSchema": {"columns": [{"name": "a", "datatype": {"base": base, "minExclusive": low, "maxExclusive": low}}]}})


def test_extraction_issues_by_kind(spark):
    cols = [{"name": "n", "propertyUrl": B + "n", "datatype": {"base": "integer", "minimum": 3}}, {"name": "s", "propertyUrl": B + "s", "datatype": {"base": "string", "maxLength": 2}},
            {"name": "d", "propertyUrl": B + "d", "datatype": {"base": "date", "format": "d.M.yyyy"}}, {"name": "b", "propertyUrl": B + "b", "datatype": {"base": "boolean", "format": "Y|N"}}, {"name": "x", "propertyUrl": B + "x", "datatype": "decimal"}]
    t = Loader(B).load({"@context": "http://www.w3.org/ns/csvw", "url": "t.csv", "tableSchema": {"aboutUrl": B + "t/{k}", "columns": cols}}).tables[0]
    rows = [lit("t/1", "n", "2"), lit("t/1", "n", "3"), lit("t/1", "s", "abc"), lit("t/1", "s", "ab"), lit("t/1", "d", "someday"), lit("t/1", "d", "2020-01-01"), lit("t/1", "b", "maybe"), lit("t/1", "x", "1e"), lit("u/1", "n", "1"), lit("t/1", "other", "1")]
    found = r2c.extraction_issues(spark.createDataFrame(rows, QUAD), t).collect()
    assert sorted((r.column, r.value, r.message.split(":")[0]) for r in found) == [
        ("b", "maybe", "the value is shown as it is"), ("d", "someday", "the value is shown as it is"), ("n", "2", "the value is left out"), ("s", "abc", "the value is left out"), ("x", "1e", "the value is shown as it is")]
    assert values.Datatype("string").uri == XSD + "string"
