"""CSV records across splits against Python's reader, and stars with hubs, constants, keys and cycles."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quadloom import runtime
from quadloom.catalogue import B, described, group
from quadloom.functions.terms import QUAD, RDF, XSD
from quadloom.issues import Issues
from quadloom.operators import c2r, r2c
from quadloom.plans.descriptor import Dialect
from quadloom.sources import records, tables


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opens = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield size
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.set("spark.sql.files.openCostInBytes", opens)


def cell(rng):
    text = "".join(rng.choice(["a", "é", "1", " ", ",", '"', "\n", "\n\n", "\r\n", "x" * 9]) for _ in range(rng.choice([0, 1, 2, 5, 12])))
    if any(c in text for c in ',"\n') or rng.random() < 0.2:
        return '"' + text.replace('"', '""') + '"'
    return text.strip("\r ") + rng.choice(["", 'q"q'] if text.strip() else [""])


@pytest.mark.parametrize("end,split", [("\n", 40), ("\r\n", 57), ("\n", 5), ("\n", 100000)])
def test_records_of_split_files_equal_pythons_reader(spark, tmp_path, small_splits, end, split):
    rng = random.Random(split)
    text = "".join(",".join(cell(rng) for _ in range(rng.choice([3, 3, 3, 2, 4]))) + end + (end if rng.random() < 0.1 else "") for _ in range(90))
    text += 'last,"open ' + "\n" * 50 + 'wide",z' + end
    (tmp_path / "t.csv").write_text(text, newline="")
    small_splits(split)
    df = tables.scan_csv(spark, str(tmp_path / "t.csv"), Dialect(header=False), width=4)
    parts = spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions()
    got = [tuple(r) for r in df.orderBy("_line").collect()]
    want = [[x for x in r] for r in csv.reader(io.StringIO(text, newline=""))]
    want = [(*[*(r or [""]), "", "", "", ""][:4], max(len(r), 1), i + 1) for i, r in enumerate(want)]
    assert got == want
    assert split > 1000 or parts > 20


def test_comments_with_quotes_blank_lines_and_escapes_in_several_files(spark, tmp_path, small_splits):
    for i, name in enumerate(("a.csv", "b.csv")):
        (tmp_path / name).write_text(f'## it"s a note\nk{i},"x\n## no note\n\ny"\n\n## "\nl{i},plain\n' * 20)
    small_splits(64)
    df = tables.scan_csv(spark, str(tmp_path), Dialect(header=False, comment_prefix="##", skip_blank_rows=True), width=2)
    got = [tuple(r) for r in df.orderBy("_line").collect()]
    assert got == [(c, v, 2, 40 * i + 2 * j + k + 1) for i in range(2) for j in range(20) for k, (c, v) in enumerate(((f"k{i}", "x\n## no note\n\ny"), (f"l{i}", "plain")))]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "e.csv").write_text('a,"b\\"\nc",d\ne,f,g\n')
    got = tables.scan_csv(spark, str(tmp_path / "e"), Dialect(header=False, double_quote=False)).orderBy("_line").collect()
    assert [tuple(r)[:3] for r in got] == [("a", 'b"\nc', "d"), ("e", "f", "g")]


def test_a_latin_file_with_breaks_stays_split(spark, tmp_path, small_splits):
    (tmp_path / "l.csv").write_bytes('é,"a\nß"\n'.encode("latin-1") * 30)
    small_splits(32)
    got = tables.scan_csv(spark, str(tmp_path / "l.csv"), Dialect(header=False, encoding="latin1")).orderBy("_line").collect()
    assert [tuple(r) for r in got] == [("é", "a\nß", 2, i + 1) for i in range(30)]


def test_issues_of_a_file_with_breaks(spark, tmp_path):
    (tmp_path / "i.csv").write_text('a,b\n1,"x\ny"\n\n3,4,5\n6\n')
    t = group(described(str(tmp_path / "i.csv"), [{"name": "a"}, {"name": "b"}])).tables[0]
    df, t = tables.read_csv(spark, str(tmp_path / "i.csv"), t)
    assert [tuple(r) for r in df.select("_row", "_c0", "_c1").orderBy("_row").collect()] == [(1, "1", "x\ny"), (2, "", ""), (3, "3", "4"), (4, "6", "")]
    assert sorted((r.row, r.message) for r in c2r.cell_issues(df, t).collect()) == [(2, "the row has 1 cells, the table 2"), (3, "the row has 3 cells, the table 2"), (4, "the row has 1 cells, the table 2")]


def test_a_very_long_cell_does_not_overflow_the_patterns(spark, tmp_path):
    (tmp_path / "v.csv").write_text('a,"' + 'x""y,\n' * 40000 + '"\nb,c\n')
    got = tables.scan_csv(spark, str(tmp_path / "v.csv"), Dialect(header=False)).orderBy("_line").collect()
    assert [(r._c0, len(r._c1), r._cells) for r in got] == [("a", 40000 * 5, 2), ("b", 1, 2)]


def test_line_states(spark):
    lines = ["a,b", 'a,"b', 'a,"b"', '"a","b', 'b",c', 'b",c,"d', 'b""', '""', 'x"y', '# "', 'a,"b""', '"""']
    out = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, v string").select("i", *records.line_states(F.col("v"), Dialect(comment_prefix="#"))).orderBy("i").collect()
    assert [(int(r[1]), int(r[2])) for r in out] == [(0, 1), (1, 0), (0, 0), (1, 1), (0, 0), (1, 1), (0, 1), (0, 1), (0, 0), (0, 0), (1, 0), (1, 0)]


# stars


def quads_of(rng, n, hub):
    rows = []
    for i in range(n):
        s = "hub" if hub and i % 2 else str(rng.randrange(n // 3))
        rows.append(("iri", B + "h/" + s, B + rng.choice("abc"), "literal", str(rng.randrange(n)), XSD + "string", None, rng.choice([None, B + "g"])))
    return list(dict.fromkeys(rows))


@pytest.mark.parametrize("needed", [(), ("a",), ("a", "b", "c")])
def test_hubs_by_joins_equal_lists(spark, needed):
    q = spark.createDataFrame(quads_of(random.Random(1), 240, True), QUAD)
    t = group(described("t.csv", [{"name": c, "propertyUrl": B + c, "required": c in needed} for c in "abc"], aboutUrl=B + "h/{h}")).tables[0]
    found = [sorted(map(tuple, r2c.table_rows(q, t, hubs=h).collect())) for h in (None, 20, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 1000


def test_hubs_with_links(spark):
    rng = random.Random(2)
    rows = [("iri", B + "h/x", B + "a", "literal", str(i), XSD + "string", None, None) for i in range(30)]
    rows += [("iri", B + "h/" + s, B + "to", "iri", B + f"c/{i}", None, None, None) for s in "xy" for i in range(25)]
    rows += [("iri", B + "h/y", B + "a", "literal", "y", XSD + "string", None, None)]
    rows += [("iri", B + f"c/{i}", B + "city", "literal", f"n{rng.randrange(9)}", XSD + "string", None, None) for i in range(0, 25, 3)]
    q = spark.createDataFrame(rows, QUAD)
    for link, city in ((True, True), (False, True), (False, False)):
        cols = [{"name": "a", "propertyUrl": B + "a", "required": True, "aboutUrl": B + "h/{h}"}, {"name": "to", "propertyUrl": B + "to", "valueUrl": B + "c/{to}", "aboutUrl": B + "h/{h}", "required": link},
                {"name": "city", "propertyUrl": B + "city", "aboutUrl": B + "c/{to}", "required": city}]
        t = group(described("t.csv", cols)).tables[0]
        found = [sorted(map(tuple, r2c.table_rows(q, t, hubs=h).collect())) for h in (None, 10)]
        assert found[0] == found[1] and found[0]


def test_seeds_are_reduced_below_the_aggregate(spark):
    q = spark.createDataFrame([("iri", B + "h/1", RDF + "type", "iri", B + "K", None, None, None)], QUAD)
    t = group(described("t.csv", [{"name": "a"}, {"name": "k", "virtual": True, "propertyUrl": "rdf:type", "valueUrl": B + "K"}], aboutUrl=B + "h/{h}")).tables[0]
    plan = r2c.table_rows(q, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate [g") < plan.index("LeftSemi")


def test_constant_values_match_iris_and_literals_of_their_type(spark):
    lit = lambda s, o, dt=XSD + "string", lang=None: ("iri", B + "c/" + s, B + "v", "literal", o, dt, lang, None)
    rows = [lit("1", "yes"), lit("2", "yes", None, "en"), lit("3", "no"), lit("4", "yes", XSD + "token"), ("iri", B + "c/5", B + "v", "iri", B + "t.csvyes", None, None, None), lit("6", "yes", None)]
    for more, want in (({}, ["1", "5", "6"]), ({"lang": "en"}, ["2", "5"]), ({"datatype": "token"}, ["4", "5"])):
        cols = [{"name": "k", "propertyUrl": B + "v", "required": True, "valueUrl": "yes", **more}]
        t = group(described("t.csv", cols, aboutUrl=B + "c/{x}")).tables[0]
        got = r2c.bindings(spark.createDataFrame(rows, QUAD), t).select("s0").collect()
        assert sorted(r.s0[-1] for r in got) == want


def test_unjoined_stars_are_an_error_unless_asked_for(spark):
    q = spark.createDataFrame([("iri", B + f"{k}/{i}", B + k, "literal", "v", XSD + "string", None, None) for k in "ab" for i in range(3)], QUAD)
    t = group(described("t.csv", [{"name": k, "propertyUrl": B + k, "required": True, "aboutUrl": B + k + "/{" + k + "}"} for k in "ab"])).tables[0]
    with pytest.raises(ValueError):
        r2c.table_rows(q, t)
    assert r2c.table_rows(q, t, product=True).count() == 9


def test_skipped_tables_are_reported(spark):
    g = group(described("a.csv", [{"name": "a"}], suppressOutput=True), described("b.csv", []), described("c.csv", [{"name": "c"}]))
    issues = Issues()
    assert list(r2c.convert(spark.createDataFrame([], QUAD), g, issues)) == [B + "c.csv"]
    assert sorted((i[1], i[2]) for i in issues.items if "skipped" in i[1]) == [("the table is skipped: it has no columns", B + "b.csv"), ("the table is skipped: its output is suppressed", B + "a.csv")]


def test_scratch_folders_can_be_listed_and_deleted(spark):
    path = runtime.scratch_path(spark, "folders")
    assert runtime.children(spark, path) == [] and not runtime.exists(spark, path)
    spark.range(3).selectExpr("id", "id as k").write.partitionBy("k").parquet(path)
    assert [x.rpartition("/")[2] for x in runtime.children(spark, path)] == ["k=0", "k=1", "k=2"]
    runtime.delete(spark, path)
    assert not runtime.exists(spark, path)


def test_chunks_are_composed_without_a_list_of_them(spark):
    rng = random.Random(8)
    rows = [(f"f{i % 3}", i * 10, *rng.choice([(0, 1), (0, 1), (1, 0), (1, 1), (0, 0)]), rng.randint(0, 3), rng.randint(0, 3)) for i in range(900)]
    found = records._chunks(spark.createDataFrame(rows, "file string, start bigint, out int, ins int, n_out bigint, n_ins bigint"))
    want, before = [], 0
    for file in ("f0", "f1", "f2"):
        state, opener = 0, None
        for _, start, out, ins, n_out, n_ins in (r for r in rows if r[0] == file):
            n = n_ins if state else n_out
            want.append((file, start, state, before, opener if state else None))
            state, before, opener = (ins if state else out), before + n, start if n else opener
    assert sorted(map(tuple, found.select("file", "start", "inside", "before", "owner").collect()), key=str) == sorted(want, key=str)
    listed = []
    real = records.F.collect_list
    try:
        records.F.collect_list = lambda c: listed.append(c) or real(c)
        records._chunks(spark.createDataFrame(rows[:3], "file string, start bigint, out int, ins int, n_out bigint, n_ins bigint"))
    finally:
        records.F.collect_list = real
    assert not listed  # what a file's list takes grows with the square of its splits
