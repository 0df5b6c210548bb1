"""Published conversion cases, read in place: a folder per case with input.ttl, a descriptor and the expected tables.
QUADLOOM_FIXTURES names the folder of cases; without it the tests are skipped."""

import csv
import json
import os
from pathlib import Path

import pytest

from quadloom.issues import Issues
from quadloom.operators import r2c
from quadloom.plans.descriptor import Loader
from quadloom.sources import rdf

ROOT = os.environ.get("QUADLOOM_FIXTURES", "")
#: Cases whose expected result contradicts the specification.
SKIPPED = {38, 39, 93, 99, 101, 195, 228, 229, 230, 259, 270, 282, 283, 284, 285, 305, 306, 307}
#: 49: constant values are shown as whole IRIs. 202, 209: an optional value outside its bounds is an empty cell here; there the row goes.
DIFFERENT = {49, 202, 209}
CASES = [p for p in sorted(Path(ROOT).iterdir()) if p.name.isdigit() and int(p.name) not in SKIPPED and (p / "input.ttl").exists()] if ROOT else []


@pytest.mark.parametrize("case", [pytest.param(p, marks=pytest.mark.xfail(strict=True) if int(p.name) in DIFFERENT else ()) for p in CASES], ids=lambda p: p.name)
def test_case(spark, case):
    descriptor = next(p for p in sorted(case.glob("*.json"), key=lambda p: ("metadata" not in p.name, p.name)))
    base = case.as_uri() + "/"
    text = descriptor.read_text()
    issues = Issues(throw=False)
    group = Loader(base + descriptor.name, lambda u: (case / u.removeprefix(base)).read_text(), issues).load(json.loads(text))
    quads = rdf.quads_of(spark, (case / "input.ttl").read_text(), base)
    got = {u.rpartition("/")[2]: sorted(tuple((k, v.strip()) for k, v in r.asDict().items()) for r in rows.collect()) for u, rows in r2c.convert(quads.distinct(), group).items()}
    want = {p.name: [tuple((k.strip(), v.strip()) for k, v in r.items()) for r in csv.DictReader(p.open())] for p in case.rglob("*.csv")}
    if len(got) == len(want) == 1:  # a file can be named otherwise than its URL
        want = {name: rows for name, rows in zip(got, want.values(), strict=True)}
    for name in got:
        assert got[name] == sorted(want[name])
