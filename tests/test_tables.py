import json

import pytest

from quadloom.issues import Issues, ValidationError, as_quads
from quadloom.functions.terms import CSVW, RDF, XSD
from quadloom.operators import c2r, infer, r2c, serialize
from quadloom.plans.descriptor import Loader
from quadloom.sources import rdf, resolve
from quadloom.sources.tables import read_csv


def load(d, issues=None, base="http://ex.org/", files=None):
    return Loader(base, (files or {}).__getitem__, issues).load(d)


def test_descriptor_checks():
    i = Issues()
    g = load({"@context": ["http://www.w3.org/ns/csvw", {"@language": "xx-not-a-tag-at-all!"}], "url": "t.csv", "dialect": {"delimiter": 1, "skipRows": -1}, "tableSchema": {"columns": [{"name": "a b", "titles": "A"}, {"name": "b", "datatype": "nope", "null": 5, "foo": 1}], "primaryKey": "zz"}}, i)
    assert g.tables[0].dialect.delimiter == "," and g.tables[0].columns[0].name == "A" and g.tables[0].columns[1].datatype.base == "string" and g.tables[0].primary_key == ()
    assert len([x for x in i.items if x[0] == "warning"]) >= 7
    for bad in ({"tables": []}, {"url": "t", "@id": "_:b"}, {"url": "t", "tableSchema": {"columns": [{"name": "a"}, {"name": "a"}]}}, {"url": "t", "tableSchema": {"columns": [{"name": "v", "virtual": True}, {"name": "a"}]}},
                {"url": "t", "tableSchema": {"columns": [{"name": "a", "datatype": {"base": "date", "length": 3}}]}}, {"url": "t", "tableSchema": {"columns": [{"name": "a", "datatype": {"base": "integer", "minimum": "3", "maximum": "1"}}]}},
                {"url": "t", "tableSchema": {"columns": [{"name": "a"}], "foreignKeys": [{"columnReference": "a", "reference": {"resource": "zz", "columnReference": "b"}}]}}):
        with pytest.raises(ValidationError):
            load(bad)


def test_expanded_form_inheritance_and_includes():
    files = {"http://ex.org/s.json": json.dumps({"@context": "http://www.w3.org/ns/csvw", "columns": [{"name": "x"}]})}
    g = load({"@context": "http://www.w3.org/ns/csvw", "tables": [{"url": "t.csv", "tableSchema": "s.json"}], "lang": "fr", "null": ["-", ""]}, files=files)
    assert g.tables[0].columns[0].lang == "fr" and g.tables[0].columns[0].null == ("-", "") and g.tables[0].schema_id == "http://ex.org/s.json"
    g = load([{"http://www.w3.org/ns/csvw#url": [{"@id": "t.csv"}], "http://www.w3.org/ns/csvw#tableSchema": [{"http://www.w3.org/ns/csvw#column": [{"http://www.w3.org/ns/csvw#name": [{"@value": "q"}]}]}]}])
    assert g.tables[0].url == "http://ex.org/t.csv" and g.tables[0].columns[0].name == "q"


def test_csv_headers_and_dialects(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("skip me\nName|First name\n#no\n'x|y'| b \n|\n", encoding="utf-8")
    i = Issues()
    t = load({"url": str(p), "dialect": {"delimiter": "|", "quoteChar": "'", "skipRows": 1, "commentPrefix": "#", "trim": True}}, i, base="").tables[0]
    df, full = read_csv(spark, str(p), t, i)
    assert [c.name for c in full.columns] == ["Name", "First%20name"]
    assert [tuple(r) for r in df.select("_c0", "_c1", "_row").orderBy("_row").collect()] == [("x|y", "b", 1), ("", "", 2)]
    p.write_text("1,2\n3,4\n")
    df, full = read_csv(spark, str(p), load({"url": str(p), "dialect": {"header": False}}, base="").tables[0])
    assert [c.name for c in full.columns] == ["_col.1", "_col.2"] and df.count() == 2


def test_full_conversion_and_back(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,when,tags\n1,10/18/2010,a;b\n2,bad,\n")
    d = {"@context": "http://www.w3.org/ns/csvw", "@type": "Table", "url": "t.csv", "dc:title": "T", "notes": [{"@type": "oa:Note"}], "tableSchema": {"aboutUrl": "#r{id}", "columns": [{"titles": "id", "datatype": "integer"}, {"titles": "when", "datatype": {"base": "date", "format": "M/d/yyyy"}}, {"titles": "tags", "separator": ";"}]}}
    g = load(d)
    q = c2r.convert(spark, g, lambda t: read_csv(spark, str(p), t)).collect()
    got = {(r.s, r.p, r.o, r.o_dt) for r in q}
    u = "http://ex.org/t.csv"
    assert {(f"{u}#r1", f"{u}#when", "2010-10-18", XSD + "date"), (f"{u}#r2", f"{u}#when", "bad", XSD + "string"), (f"{u}#r1", f"{u}#tags", "a", XSD + "string"), (f"{u}#r1", f"{u}#tags", "b", XSD + "string"),
            ("_:t0r2", CSVW + "url", f"{u}#row=3", None), ("_:t0r1", CSVW + "describes", f"{u}#r1", None), ("_:t0", "http://purl.org/dc/terms/title", "T", XSD + "string"), ("_:g", RDF + "type", CSVW + "TableGroup", None)} <= got
    assert not any(r.s == f"{u}#r2" and r.p.endswith("tags") for r in q)
    df, full = read_csv(spark, str(p), g.tables[0])
    assert [(r.row, r.column) for r in c2r.cell_issues(df, full).collect()] == [(2, "when")]
    assert as_quads(c2r.cell_issues(df, full)).count() == 5
    back = r2c.table_rows(spark.createDataFrame(q, rdf.QUAD), full)
    assert sorted(map(tuple, back.collect())) == [("1", "10/18/2010", "a"), ("1", "10/18/2010", "b"), ("2", "bad", "")]


TURTLE = """@prefix : <http://e/> . @base <http://b/> .
:a a :T ; :p "x\\n\\"y\\""@en-GB , 'z' , 1.5 , 2e3 , true ; :q ( 1 [ :r <rel> ] ) .
_:n :p \"\"\"long "quoted" text\"\"\"^^:dt .
[] :p [ :q :a ] .
"""


def test_rdf_readers(spark, tmp_path):
    rows = rdf.Turtle(TURTLE).parse()
    text = {(r[2], r[4], r[5], r[6]) for r in rows}
    assert ("http://e/p", 'x\n"y"', RDF + "langString", "en-GB") in text and ("http://e/p", "2e3", XSD + "double", None) in text and ("http://e/r", "http://b/rel", None, None) in text and ("http://e/p", 'long "quoted" text', "http://e/dt", None) in text
    assert len(rows) == 1 + 5 + 1 + 4 + 1 + 1 + 2
    trig = rdf.Turtle("@prefix : <http://e/> . { :a :b :c } :g { :a :b :d . :x :y :z }").parse()
    assert [r[7] for r in trig] == [None, "http://e/g", "http://e/g"]
    x = rdf.parse_rdfxml(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/"><e:T rdf:about="http://a" e:n="v"><e:p rdf:resource="b"/><e:q xml:lang="de">t</e:q><e:r rdf:parseType="Collection"><rdf:Description rdf:about="http://c"/></e:r></e:T></rdf:RDF>', "http://base/")
    assert {("http://e/p", "http://base/b"), ("http://e/q", "t"), (RDF + "first", "http://c"), (RDF + "rest", RDF + "nil"), ("http://e/n", "v")} <= {(r[2], r[4]) for r in x}
    j = rdf.parse_jsonld(json.dumps({"@context": {"e": "http://e/", "k": {"@id": "e:k", "@type": "@id"}}, "@id": "e:a", "@type": "e:T", "k": "http://x", "e:l": {"@list": [1, "b"]}, "e:n": {"e:m": {"@value": "v", "@language": "en"}}}))
    assert {("http://e/k", "http://x"), ("http://e/m", "v"), (RDF + "first", "1")} <= {(r[2], r[4]) for r in j}
    p = tmp_path / "x.nq"
    p.write_text('<http://a> <http://b> "q\\"\\\\n\\u00e9"@en <http://g> .\n# comment\n\n_:x <http://b> "1"^^<http://dt> .\n<http://a> <http://b> <http://c>.\n')
    q = [tuple(r) for r in rdf.read_rdf(spark, str(p)).collect()]
    assert q[0] == ("iri", "http://a", "http://b", "literal", 'q"\\né', RDF + "langString", "en", "http://g") and q[1][:2] == ("bnode", "_:x") and q[1][5] == "http://dt" and q[2][4] == "http://c"


def test_writers_round_trip(spark, tmp_path):
    q = rdf.quads_of(spark, TURTLE)
    for fmt in ("nquads", "turtle", "trig", "jsonld"):
        path = str(tmp_path / fmt)
        serialize.write(q, path, fmt)
        if fmt != "jsonld":
            back = rdf.read_rdf(spark, path + "/part-*", "http://base/x.ttl")
            assert back.count() == q.count()
    with pytest.raises(ValueError):
        serialize.write(q, str(tmp_path / "x"), "rdfxml")
    assert serialize.format_of("a.nq") == "nquads" and serialize.format_of("a") == "turtle"


def test_inference_and_edits(spark):
    q = rdf.quads_of(spark, "@prefix e: <http://e/> . <http://e/i/1> a e:T ; e:n 1 ; e:m 'a','b' . <http://e/i/2> a e:T ; e:n 2.5 . <http://e/x> e:free 'y' .")
    g = infer.infer(q)
    assert [t["url"] for t in g["tables"]] == ["T.csv", "T_m.csv", "unknown_type.csv"]
    assert g["tables"][0]["tableSchema"]["columns"][1]["datatype"] == "decimal" and g["tables"][0]["tableSchema"]["columns"][0]["aboutUrl"] == "http://e/i/{subject_id}"
    out = {k.rpartition("/")[2]: sorted(map(tuple, df.collect())) for k, df in r2c.convert(q, load(g)).items()}
    assert out["T.csv"] == [("1", "1"), ("2", "2.5")] and out["T_m.csv"] == [("1", "a"), ("1", "b")]
    h = infer.rename_table(g, "T.csv", "U.csv")
    assert h["tables"][1]["tableSchema"]["foreignKeys"][0]["reference"]["resource"] == "U.csv" and g["tables"][0]["url"] == "T.csv"
    assert infer.remove_table(h, "U.csv")["tables"][0]["tableSchema"]["foreignKeys"] == []
    with pytest.raises(ValueError):
        infer.remove_column(g, "T.csv", "subject_id")
    moved = infer.move_columns(infer.add_table(g, "n.csv"), "T.csv", "n.csv", ["n1"])
    assert [c["name"] for c in moved["tables"][-1]["tableSchema"]["columns"]] == ["subject_id", "n1"]


def test_resolvers(tmp_path):
    assert resolve.override("http://a/b/c", [("http://a/", "file:///x/"), ("http://a/b/", "file:///y/")]) == "file:///y/c"
    assert resolve.override("http://a1/c", [(r"^http://a\d/", "/z/")]) == "/z/c"
    assert resolve.link_metadata('<m.json>; rel="describedby"; type="application/csvm+json", <n>; rel=next') == "m.json"
    (tmp_path / "t.csv").write_text("a\n1\n")
    (tmp_path / "t.csv-metadata.json").write_text(json.dumps({"url": "t.csv"}))
    found = resolve.discover(str(tmp_path / "t.csv"))
    assert found and found[0].endswith("t.csv-metadata.json")
    (tmp_path / "t.csv-metadata.json").write_text(json.dumps({"url": "other.csv"}))
    assert resolve.discover(str(tmp_path / "t.csv")) is None
