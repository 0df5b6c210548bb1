"""Streams to tables: rings, windows, rows as they come, schemas that only grow."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadloom import runtime, stream_queries
from quadloom.catalogue import B, described, group
from quadloom.functions.terms import QUAD, QUAD_COLUMNS, RDF, XSD
from quadloom.operators import infer, r2c
from quadloom.sources import rdf
from quadloom.streaming import extract, schema, windows


def literal(s, p, o, g=None, lang=None):
    return ("iri", B + s, B + p, "literal", o, XSD + "string" if lang is None else None, lang, g)


def link(s, p, o, g=None):
    return ("iri", B + s, p if "://" in p else B + p, "iri", B + o, None, None, g)


def column(name, about, **more):
    return {"name": name, "aboutUrl": B + about, "propertyUrl": B + name, **more}


def run(spark, batches, g, name):
    stream = stream_queries.in_batches([spark.createDataFrame(b, QUAD) for b in batches], name)
    return {u: sorted(map(tuple, windows.materialised(rows, name).collect())) for u, rows in extract.row_stream(stream, g).items()}


def settled(spark, quads, g):
    return {u: sorted(map(tuple, rows.collect())) for u, rows in r2c.convert(rdf.as_set(spark.createDataFrame(quads, QUAD)), g).items()}


def people(rng, n=25):
    quads = []
    for i in range(n):
        graph = rng.choice([None, None, B + "g"])
        quads += [literal(f"p/{i}", "name", f"n{k}", graph) for k in range(rng.randint(0, 2))]
        quads += [link(f"p/{i}", "home", f"c/{rng.randrange(6)}", graph) for _ in range(rng.randint(0, 2))]
    for c in range(5):
        for graph in (None, B + "g"):
            quads += [literal(f"c/{c}", "city", f"city{c}{k}", graph) for k in range(rng.randint(0, 2))]
    return list(dict.fromkeys(quads))


def test_rows_of_a_stream_are_those_of_its_quads_in_any_order(spark):
    """Needed columns and links only: what the stream gave in the end is what the quads give at once, each solution once."""
    g = group(described("t.csv", [column("name", "p/{p}", required=True), {**column("home", "p/{p}", required=True), "valueUrl": B + "c/{home}"}, column("city", "c/{home}", required=True)]))
    for seed in (1, 2):
        rng = random.Random(seed)
        quads = people(rng)
        rng.shuffle(quads)
        cut = sorted(rng.sample(range(8, len(quads) - 8), 2))
        batches = [quads[: cut[0]], quads[cut[0] : cut[1]] + quads[:5], quads[cut[1] :], quads[3:20]]
        assert run(spark, batches, g, f"any{seed}") == settled(spark, quads, g)


def test_optional_values_that_come_later_give_rows_anew(spark):
    g = group(described("t.csv", [column("name", "p/{p}", required=True), column("nick", "p/{p}"), {**column("home", "p/{p}"), "valueUrl": B + "c/{home}"}, column("city", "c/{home}", required=True)]))
    first = [literal("p/1", "name", "a"), literal("p/2", "name", "b"), literal("p/2", "nick", "bb"), link("p/1", "home", "c/1"), *[literal(f"x/{i}", "name", "other") for i in range(4)]]
    second = [literal("p/1", "nick", "aa"), literal("c/1", "city", "town"), literal("c/1", "city", "ville"), *first[:1]] * 2
    got = run(spark, [first, second, second, first], g, "late")
    assert got[B + "t.csv"] == sorted([("a", "", "", ""), ("b", "bb", "", ""), ("a", "", "1", "town"), ("a", "", "1", "ville"), ("a", "aa", "1", "town"), ("a", "aa", "1", "ville")])


def test_typed_and_all_optional_stars(spark):
    g = group(described("t.csv", [column("a", "p/{p}"), column("b", "p/{p}")]), described("u.csv", [column("a", "p/{p}"), {"name": "k", "virtual": True, "aboutUrl": B + "p/{p}", "propertyUrl": "rdf:type", "valueUrl": B + "Kind"}]))
    batches = [[literal("p/1", "a", "x"), literal("p/2", "a", "y"), literal("p/3", "c", "z"), literal("p/4", "c", "z")], [literal("p/1", "b", "w"), link("p/2", RDF + "type", "Kind"), link("p/3", RDF + "type", "Kind"), link("p/1", RDF + "type", "Other")]]
    got = run(spark, batches, g, "typed")
    assert got[B + "t.csv"] == [("x", ""), ("x", "w"), ("y", "")]
    assert got[B + "u.csv"] == [("",), ("y",)]


def test_links_that_lead_back_have_no_stream(spark):
    g = group(described("t.csv", [{**column("ab", "a/{i}", required=True), "valueUrl": B + "b/{j}"}, {**column("ba", "b/{j}", required=True), "valueUrl": B + "a/{i}"}]))
    with pytest.raises(ValueError):
        extract.row_stream(spark.createDataFrame([], QUAD), g)


def test_solutions_hold_a_new_value_each_and_are_all_there():
    rng = random.Random(3)
    for _ in range(300):
        slots, needed = [0, 1, 2], [s for s in (0, 1, 2) if rng.random() < 0.4]
        star = extract.StarValues(slots, needed, slots)
        seen, every, given = {s: [] for s in slots}, {s: [] for s in slots}, []
        for batch in range(3):
            new = {s: [f"{s}{batch}{k}" for k in range(rng.choice([0, 0, 1, 2]))] for s in slots}
            given += list(star.solutions(seen, new))
            seen = {s: seen[s] + new[s] for s in slots}
            every = seen
        assert len(given) == len(set(given))
        if all(every[s] for s in needed) and any(every.values()):
            assert {(a, b, c) for a in every[0] or [None] for b in every[1] or [None] for c in every[2] or [None]} <= set(given)
        else:
            assert not given


class Kept:
    """A list state in memory."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        return iter(list(self.rows))

    def appendList(self, rows):
        self.rows += rows
        self.calls += 1

    def put(self, rows):
        self.rows = list(rows)
        self.calls += 1

    def getListState(self, name, schema):
        return self


def test_one_call_of_the_state_store_takes_many_subjects():
    state, star = Kept(), extract.StarValues([0, 1], [0], [0, 1])
    star.init(state)
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["g", "s", "slot", "id", "o"], dtype=object)])
    give = lambda rows: [r for f in star.handleInputRows((5,), frame(rows), None) for r in f.itertuples(index=False, name=None)]
    first = [("", f"s{i}", 0, f"i{i}", f"o{i}") for i in range(1000)]
    assert sorted(give(first)) == sorted(("", f"s{i}", f"o{i}", None) for i in range(1000)) and state.calls == 1
    assert give(first[:10]) == [] and state.calls == 1
    assert give([("", "s3", 1, "x", "late"), ("", "new", 1, "x", "y")]) == [("", "s3", "o3", "late")] and state.calls == 2


def test_facts_of_many_subjects_are_kept_by_one_call_and_replaced_ones_go():
    state, found = Kept(), schema.SubjectFacts()
    found.init(state)
    fact = lambda o: json.dumps({**dict.fromkeys(infer.FACTS), "vlo": [o, None, None], "vhi": [o, None, None], "dts": ["string"]})
    for k in range(9):
        rows = [("", f"s{i}", True, "p", fact(f"{k}"), "[]") for i in range(100)]
        out = [f for f in found.handleInputRows((5,), iter([pd.DataFrame(rows, columns=["g", "s", "named", "p", "facts", "classes"], dtype=object)]), None)]
        assert sum(map(len, out)) == (200 if k == 0 else 100) and state.calls == k + 1
        assert sum(len(json.loads(text)) for (text,) in state.rows) <= 400
    assert {json.loads(r)[0][4]["vhi"][0] for (r,) in state.rows[-1:]} == {"8"}


def test_ring_of_late_repeated_and_early_quads(spark):
    size, step = 20, 2
    own = [(*literal("s", "p", str(n)), n) for n in range(57)]
    rng = random.Random(4)
    late = own[:30] + own[40:50] + [own[7]] * 2 + own[30:40] + own[50:]
    for rows in (own, late):
        batches = [rows[i : i + 12] for i in range(0, len(rows), 12)]
        rng.shuffle(batches[0])
        stream = stream_queries.in_batches([spark.createDataFrame(b, QUAD + ", n bigint") for b in batches], "ring")
        got = sorted((r.step, r.change, r.n) for r in windows.materialised(extract.window_changes(stream, size), "changes").collect())
        want = [(extract.added_at(n, size, step), "added", n) for n in range(57)] + [(extract.added_at(n + size, size, step), "removed", n) for n in range(57 - size)]
        assert sorted(set(got)) == sorted(want) if rows is late else got == sorted(want)


def test_windows_are_converted_as_they_close_and_old_steps_go(spark):
    g = group(described("t.csv", [column("a", "p/{p}", required=True), column("b", "p/{p}")]))
    rows = [(*literal(f"p/{n // 2}", "ab"[n % 2], f"v{n}"), n) for n in range(103)]
    batches = [rows[i : i + 25] for i in range(0, 103, 25)]
    checkpoint, found, steps = runtime.scratch_path(spark, "closing"), [], []

    def emit(url, table, batch):
        found.extend((batch, *r) for r in table.collect())
        steps.append(len([x for f in runtime.children(spark, checkpoint + "-window/quads") for x in runtime.children(spark, f)]))

    stream = stream_queries.in_batches([spark.createDataFrame(b, QUAD + ", n bigint") for b in batches], "closing")
    extract.convert_windows(stream, g, 20, emit, checkpoint).awaitTermination()
    (rest,) = extract.last_windows(spark, g, 20, checkpoint).values()
    got = sorted((r[3], r[1], r[2]) for r in found) + sorted((r.window, r.a, r.b) for r in rest.collect())
    want = []
    for w in range(103 // 2 + 1):
        inside = {n for n in range(103) if 2 * w <= n < 2 * w + 20}
        want += [(w, f"v{n}", f"v{n + 1}" if n + 1 in inside else "") for n in inside if n % 2 == 0]
    assert sorted(got) == sorted(want)
    assert max(steps) <= 40  # the steps of a window and of two batches, however long the stream
    last = {b for b, *_ in found}
    assert len(last) >= 4  # windows come batch by batch, not at the end


def test_a_batch_of_many_steps_is_kept_in_few_folders(spark):
    g = group(described("t.csv", [column("a", "p/{p}", required=True)]))
    rows, checkpoint, found = [(*literal(f"p/{n}", "a", f"v{n}"), n) for n in range(150)], runtime.scratch_path(spark, "many"), []

    def emit(url, table, batch):
        found.append(sum(len(runtime.children(spark, f)) for f in runtime.children(spark, checkpoint + "-window/quads")))

    stream = stream_queries.in_batches([spark.createDataFrame(rows, QUAD + ", n bigint")], "many")
    extract.convert_windows(stream, g, 10, emit, checkpoint).awaitTermination()
    (rest,) = extract.last_windows(spark, g, 10, checkpoint).values()
    assert found and max(found) <= 18
    assert sorted(map(tuple, rest.select("window", "a").collect())) == sorted((w, f"v{n}") for w in range(141, 150) for n in range(w, 150))


def facts(rows):
    return sorted((r["class"], r.p or "", tuple(r.dts), r.lo, r.hi, r.rlo, r.rhi, r.smin, r.smax, r.lang, r.multi, str(r.vlo), str(r.vhi)) for r in rows)


def mixed_quads(rng, n=40):
    quads = []
    for i in range(n):
        s = f"s/{i}"
        quads += [link(s, RDF + "type", rng.choice(["A", "B"])) for _ in range(rng.choice([0, 1, 1, 2]))]
        quads += [literal(s, rng.choice("pqr"), rng.choice("xyz"), lang=rng.choice([None, "en", "de"])) for _ in range(rng.randint(0, 4))]
        quads += [link(s, "to", rng.choice(["a/1", "a/2", "b=3", "q/1/2"])) for _ in range(rng.randint(0, 2))]
        quads += [("bnode", f"_:b{i}", B + "p", "literal", str(i), XSD + "integer", None, None)]
    return list(dict.fromkeys(quads))


def test_observations_merge_in_any_order_and_however_cut(spark):
    rng = random.Random(5)
    quads = mixed_quads(rng)
    want = facts(infer.summary(infer.observations(spark.createDataFrame(quads, QUAD))).collect())
    rng.shuffle(quads)
    a, b, c = (infer.observations(spark.createDataFrame(quads[i::3], QUAD)) for i in range(3))
    assert facts(infer.summary(infer.merge(infer.merge(c, a), b)).collect()) == want
    assert facts(infer.summary(infer.merge(b, infer.merge(a, a), c)).collect()) == want


def test_fact_stream_equals_the_summary_of_its_quads(spark):
    """Subjects whose classes come first; others leave what was given without a class."""
    rng = random.Random(6)
    quads = sorted(mixed_quads(rng), key=lambda q: q[2] != RDF + "type")
    typed = [q for q in quads if q[2] == RDF + "type"]
    rest = [q for q in quads if q[2] != RDF + "type"]
    stream = stream_queries.in_batches([spark.createDataFrame(x, QUAD) for x in (typed, rest[::2], rest[1::2] + rest[:9])], "facts")
    got = infer.merge_summaries(windows.materialised(schema.fact_stream(stream), "facts"))
    want = [r for r in facts(infer.summary(infer.observations(spark.createDataFrame(quads, QUAD))).collect())]
    assert facts(got.collect()) == want


def test_locked_templates_fit_every_iri_and_frozen_tables_stay(spark):
    one = spark.createDataFrame([link("s/1", RDF + "type", "A"), literal("s/1", "p", "x"), link("s/1", "to", "a/1")], QUAD)
    two = spark.createDataFrame([link("s/1", RDF + "type", "A"), literal("s/1", "p", "y"), literal("s/1", "q", "z"), link("t/9", RDF + "type", "C"), literal("t/9", "p", "x")], QUAD)
    rows = lambda df: infer.summary(df).withColumn("level", F.col("smin") == F.col("smax")).collect()
    seen = infer.observations(one)
    first = infer.describe(rows(seen))
    locked = infer.lock(first)
    assert [c["aboutUrl"] for c in locked["tables"][0]["tableSchema"]["columns"]] == ["{+subject_id}"] * 3
    assert locked["tables"][0]["tableSchema"]["columns"][2]["valueUrl"].startswith("{+to")
    then = infer.describe(rows(infer.merge(seen, infer.observations(two))), group=locked, lock=True)
    assert then["tables"][0] == locked["tables"][0]
    assert [t["url"] for t in then["tables"]] == ["A.csv", "A_q.csv", "C.csv"]
    assert infer.describe(rows(infer.merge(seen, infer.observations(two))), group=then, lock=True) == then


def test_quad_columns_are_the_quads():
    assert [c.split()[0] for c in QUAD.split(", ")] == QUAD_COLUMNS


def test_parts_under_lock_are_read_once(spark, monkeypatch):
    names, real = [], runtime.materialize
    monkeypatch.setattr(runtime, "materialize", lambda df, name: names.append(name) or real(df, name))
    assert stream_queries.infer_locked(spark, "/root/testdata/sf0.001").count() == 5
    assert names == ["observations"] * 3
